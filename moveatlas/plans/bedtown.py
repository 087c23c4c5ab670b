"""Bed-town indicator on purpose counts: evening trips home on weekdays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.functions.scalar import eps_ratio, value_when
from moveatlas.operators.aggregates import group_totals
from moveatlas.operators.features import add_row_sums
from moveatlas.operators.ranking import rank_rows, top_ranked
from moveatlas.plans import scopes


def return_ratio(counts: DataFrame, period: scopes.Period, key: str = S.PLACE) -> DataFrame:
    """Visitors returning home over all visitors, per group."""
    rows = add_row_sums(scopes.bedtown_scope(period).apply(counts), {"SUM_TOTAL": S.COUNT_COLS})
    returning = value_when(F.col("MOVE_PURPOSE") == S.RETURN_HOME, "SUM_TOTAL")
    totals = group_totals(rows, key, {"ANNUAL_RETURN": returning, "ANNUAL_TOTAL": "SUM_TOTAL"})
    return totals.withColumn("RETURN_RATIO", eps_ratio("ANNUAL_RETURN", "ANNUAL_TOTAL"))


def bedtown_top(
    counts: DataFrame, period: scopes.Period, key: str = S.PLACE, k: int = 30
) -> DataFrame:
    """The k groups with the highest return ratio, ranked."""
    top = top_ranked(return_ratio(counts, period, key), "RETURN_RATIO", key, k)
    return top.select("RANK", key, "ANNUAL_RETURN", "ANNUAL_TOTAL", "RETURN_RATIO")


def bedtown_ranking(counts: DataFrame, period: scopes.Period, key: str = S.PLACE) -> DataFrame:
    """All groups by return ratio, ranked."""
    ranked = rank_rows(return_ratio(counts, period, key), "RETURN_RATIO", key)
    return ranked.select("RANK", key, "ANNUAL_RETURN", "ANNUAL_TOTAL", "RETURN_RATIO")
