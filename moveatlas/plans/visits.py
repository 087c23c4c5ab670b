"""Visitor totals and the shopping and tourism score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.functions.scalar import eps_ratio, fill_zero, fourth_root, to_double
from moveatlas.operators import filters
from moveatlas.operators.aggregates import group_means, group_totals, min_positive
from moveatlas.plans import scopes
from moveatlas.plans.hotness import visitor_rows


def with_ratio_score(totals: DataFrame) -> DataFrame:
    return totals.withColumn(
        "RATIO_SCORE", fourth_root(eps_ratio("ANNUAL_SHOP_TOUR", "ANNUAL_TOTAL_VISITORS"))
    )


def ratio_scores(counts: DataFrame, period: scopes.Period, key: str = S.PLACE) -> DataFrame:
    """``(shopping and tourism / all visitors)^¼`` per group."""
    totals = group_totals(
        visitor_rows(counts, period),
        key,
        {"ANNUAL_SHOP_TOUR": "SHOPPING_TOUR_SUM", "ANNUAL_TOTAL_VISITORS": "TOTAL_VISITORS"},
    )
    return with_ratio_score(totals)


def score_floor(scores: DataFrame, score: str = "RATIO_SCORE") -> DataFrame:
    """Smallest positive score and the number of zero scores, in one pass."""
    value = F.col(score)
    return scores.agg(
        F.min(F.when(value > 0, value)).alias("min_positive"),
        F.count_if(value == 0).alias("zero_count"),
    )


def fill_zero_scores(scores: DataFrame, score: str = "RATIO_SCORE") -> DataFrame:
    """Add ``{score}_FILLED``: zero scores take the smallest positive one.

    The minimum is a scalar subquery over the same group-level frame, so the
    aggregation's shuffle is reused and no scan repeats.
    """
    smallest = min_positive(scores, score).scalar()
    return scores.withColumn(f"{score}_FILLED", fill_zero(score, smallest))


def annual_visitors(counts: DataFrame, period: scopes.Period, key: str = S.PLACE) -> DataFrame:
    return group_totals(
        visitor_rows(counts, period), key, {"YEAR_TOTAL_VISITORS": "TOTAL_VISITORS"}
    )


def tourism_totals(counts: DataFrame, period: scopes.Period, key: str = S.PLACE) -> DataFrame:
    """Sum of ``TOTAL_CNT`` for the tourism purpose."""
    rows = filters.purposes(filters.date_range(counts, *period), [S.TOURISM])
    return group_totals(rows, key, {"ANNUAL_TOURISM_CNT": to_double("TOTAL_CNT")})


def place_rows(
    counts: DataFrame,
    period: scopes.Period,
    place: str | Column,
    purposes: tuple[str, ...] = S.SHOP_TOUR,
) -> DataFrame:
    """All rows of one place for the chosen purposes, with the parsed date."""
    rows = filters.region(filters.date_range(counts, *period), full_nm=place)
    rows = filters.purposes(rows, purposes)
    return rows.withColumn(S.DATE_COL, filters.date_of(rows))


def mean_by_purpose(counts: DataFrame) -> DataFrame:
    return group_means(counts, "MOVE_PURPOSE", {"avg_cnt": to_double("TOTAL_CNT")})
