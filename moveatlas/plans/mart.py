"""Every linear indicator total in one scan.

Each published indicator reads the whole period again with its own filters.
Here the filters become conditions of grouped sums over one scan, followed by
one shuffle of one partial row per group and task. Use the single plans for one
question, where filters reach the scan, and the mart for all of them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.functions.scalar import eps_ratio, to_double, value_when, zero_sum
from moveatlas.operators import filters
from moveatlas.operators.features import add_row_sums
from moveatlas.plans import hotness, scopes, visits

#: A period that holds every day.
EVERY_DAY = ("00010101", "99991231")

SCOPE_NAMES = ("evening_home", "daytime", "visit", "women", "teens", "tourism")

# Output total: (condition, summed row value), over the columns of _row_level.
TOTALS = {
    "home_return": ("in_evening_home AND is_home", "total"),
    "home_total": ("in_evening_home", "total"),
    "hotness_sum": ("in_daytime", "hotness"),
    "daytime_shop_tour": ("in_daytime AND is_shop_tour", "total"),
    "daytime_total": ("in_daytime", "total"),
    "visit_shop_young": ("in_visit AND is_shop_tour", "young"),
    "visit_young": ("in_visit", "young"),
    "visit_total": ("in_visit", "total"),
    "women_2039": ("in_women", "women"),
    "women_scope_total": ("in_women", "total"),
    "teens_1029": ("in_teens", "teens"),
    "teens_scope_total": ("in_teens", "total"),
    "tourism_cnt": ("in_tourism", "total_cnt"),
}


def _row_level(counts: DataFrame, period: scopes.Period, keys: list[str]) -> DataFrame:
    rows = filters.date_range(counts, *period)
    # The period holds for every row by now; each scope adds only its own filters.
    wanted = {
        "evening_home": scopes.bedtown_scope(period),
        "daytime": scopes.hotness_scope(period),
        "visit": scopes.visit_scope(period),
        "women": scopes.women_scope(period),
        "teens": scopes.teens_scope(period),
        "tourism": scopes.tourism_scope(period),
    }
    summed = add_row_sums(
        rows,
        {
            "total": S.COUNT_COLS,
            "young": S.YOUNG_COLS,
            "women": S.WOMEN_2039_COLS,
            "teens": S.TEENS_TWENTIES_COLS,
        },
    )
    return summed.select(
        *keys,
        *(
            F.coalesce(replace(scope, ymd=None).holds(rows), F.lit(False)).alias(f"in_{name}")
            for name, scope in wanted.items()
        ),
        (F.col("MOVE_PURPOSE") == S.RETURN_HOME).alias("is_home"),
        hotness.is_shop_tour().alias("is_shop_tour"),
        "total",
        "young",
        "women",
        "teens",
        value_when(F.col("MOVE_PURPOSE") == S.TOURISM, to_double("TOTAL_CNT"), otherwise=None).alias(
            "total_cnt"
        ),
    )


def with_hotness(rows: DataFrame, zero_division: str) -> DataFrame:
    value = hotness.hotness_of(
        eps_ratio("young", "total"),
        value_when(F.col("is_shop_tour"), "total"),
        F.col("total"),
        zero_division,
    )
    return rows.withColumn("hotness", F.when(F.col("in_daytime"), value))


def grouped_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and row counts of every indicator over rows of ``_row_level``."""
    return rows.groupBy(*keys).agg(
        *(F.expr(f"count_if(in_{name})").alias(f"rows_{name}") for name in SCOPE_NAMES),
        *(
            F.expr(f"coalesce(sum(CASE WHEN {test} THEN {value} END), 0D)").alias(name)
            for name, (test, value) in TOTALS.items()
        ),
    )


def monthly_mart(
    counts: DataFrame,
    keys: str | Iterable[str] = (S.PROVINCE, S.DISTRICT, S.PLACE),
    zero_division: str = "ieee",
) -> DataFrame:
    """One row per month and group: partial totals that add up over months and batches."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = _row_level(counts.withColumn("__month", filters.month_of(counts)), EVERY_DAY, [*keys, "__month"])
    months = grouped_totals(with_hotness(rows, zero_division), [*keys, "__month"])
    return months.withColumnRenamed("__month", S.MONTH_COL)


def indicator_mart(
    counts: DataFrame,
    period: scopes.Period,
    keys: str | Iterable[str] = (S.PROVINCE, S.DISTRICT, S.PLACE),
    zero_division: str = "ieee",
) -> DataFrame:
    """One row per group with the totals and row counts of every indicator."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return grouped_totals(with_hotness(_row_level(counts, period, keys), zero_division), keys)


def roll_up(mart: DataFrame, keys: str | Iterable[str]) -> DataFrame:
    """Totals of a coarser key from a finer mart; the scan is not repeated."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    counted = [f"rows_{name}" for name in SCOPE_NAMES]
    return mart.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in counted), *(zero_sum(c).alias(c) for c in TOTALS)
    )


def bedtown_from_mart(mart: DataFrame, key: str = S.PLACE) -> DataFrame:
    return (
        mart.filter(F.col("rows_evening_home") > 0)
        .select(
            key,
            F.col("home_return").alias("ANNUAL_RETURN"),
            F.col("home_total").alias("ANNUAL_TOTAL"),
        )
        .withColumn("RETURN_RATIO", eps_ratio("ANNUAL_RETURN", "ANNUAL_TOTAL"))
    )


def hotness_from_mart(mart: DataFrame, key: str = S.PLACE) -> DataFrame:
    return mart.filter(F.col("rows_daytime") > 0).select(
        key, F.col("hotness_sum").alias("ANNUAL_HOTNESS")
    )


def ratio_scores_from_mart(mart: DataFrame, key: str = S.PLACE) -> DataFrame:
    return visits.with_ratio_score(
        mart.filter(F.col("rows_daytime") > 0).select(
            key,
            F.col("daytime_shop_tour").alias("ANNUAL_SHOP_TOUR"),
            F.col("daytime_total").alias("ANNUAL_TOTAL_VISITORS"),
        )
    )


def visitors_from_mart(mart: DataFrame, key: str = S.PLACE) -> DataFrame:
    return mart.filter(F.col("rows_daytime") > 0).select(
        key, F.col("daytime_total").alias("YEAR_TOTAL_VISITORS")
    )


def young_ratio_from_mart(mart: DataFrame, key: str = S.PLACE) -> DataFrame:
    totals = mart.filter(F.col("rows_visit") > 0).select(
        key, F.col("visit_young").alias("ANNUAL_YOUNG"), F.col("visit_total").alias("ANNUAL_TOTAL")
    )
    return totals.withColumn("ANNUAL_YOUNG_RATIO", eps_ratio("ANNUAL_YOUNG", "ANNUAL_TOTAL"))


def young_shop_tour_from_mart(
    mart: DataFrame, key: str = S.PLACE, zero_division: str = "ieee"
) -> DataFrame:
    totals = mart.filter(F.col("rows_visit") > 0).select(
        key,
        F.col("visit_shop_young").alias("ANNUAL_SHOP_YOUNG"),
        F.col("visit_young").alias("ANNUAL_YOUNG"),
        F.col("visit_total").alias("ANNUAL_TOTAL"),
    )
    return hotness.with_hotness2(totals, zero_division)


def women_share_from_mart(
    mart: DataFrame, key: str = S.PLACE, zero_division: str = "ieee"
) -> DataFrame:
    totals = mart.filter(F.col("rows_women") > 0).select(
        key,
        F.col("women_2039").alias("ANNUAL_FEML2030"),
        F.col("women_scope_total").alias("ANNUAL_WEEKEND_TOTAL"),
    )
    return hotness.with_root_share(
        totals, "ANNUAL_FEML2030", "ANNUAL_WEEKEND_TOTAL", "HOTNESS3", zero_division
    )


def teens_twenties_from_mart(
    mart: DataFrame, key: str = S.PLACE, zero_division: str = "ieee"
) -> DataFrame:
    totals = mart.filter(F.col("rows_teens") > 0).select(
        key,
        F.col("teens_1029").alias("ANNUAL_1020"),
        F.col("teens_scope_total").alias("ANNUAL_WEEKEND_TOTAL"),
    )
    return hotness.with_root_share(
        totals, "ANNUAL_1020", "ANNUAL_WEEKEND_TOTAL", "HOTNESS4", zero_division
    )


def tourism_from_mart(mart: DataFrame, key: str = S.PLACE) -> DataFrame:
    return mart.filter(F.col("rows_tourism") > 0).select(
        key, F.col("tourism_cnt").alias("ANNUAL_TOURISM_CNT")
    )
