"""Hot-place indicators on purpose counts.

All of them take the counts and a period, group by place unless another key is
given, and return one row per group. Divisions follow floating-point rules by
default: a row without visitors is NaN and makes its group NaN; pass
``zero_division='null'`` to leave such rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.functions.scalar import (
    eps_ratio,
    flag,
    fourth_root,
    ieee_divide,
    offset_log,
    value_when,
)
from moveatlas.operators.aggregates import group_totals
from moveatlas.operators.features import add_row_sums
from moveatlas.plans import scopes

HOTNESS2_LOG_OFFSET = 1e6
VISITORS = {"YOUNG_VISITORS": S.YOUNG_COLS, "TOTAL_VISITORS": S.COUNT_COLS}


def is_shop_tour() -> Column:
    return F.col("MOVE_PURPOSE").isin(*S.SHOP_TOUR)


def hotness_of(
    young_ratio: Column, shop_tour: Column, total: Column, zero_division: str = "ieee"
) -> Column:
    """``young_ratio^¼ · shop_tour / total^¼ · ln(1 + total)``, left to right."""
    weighted = fourth_root(young_ratio) * shop_tour
    return ieee_divide(weighted, fourth_root(total), zero_division) * F.log1p(total)


def visitor_rows(counts: DataFrame, period: scopes.Period) -> DataFrame:
    """Rows in the hotness scope with their visitor sums and young ratio."""
    rows = add_row_sums(scopes.hotness_scope(period).apply(counts), VISITORS)
    return rows.withColumns(
        {
            "SHOPPING_TOUR_SUM": value_when(is_shop_tour(), "TOTAL_VISITORS"),
            "YOUNG_RATIO": eps_ratio("YOUNG_VISITORS", "TOTAL_VISITORS"),
        }
    )


def hotness_rows(
    counts: DataFrame, period: scopes.Period, zero_division: str = "ieee"
) -> DataFrame:
    """Row-level HOTNESS."""
    return visitor_rows(counts, period).withColumn(
        "HOTNESS",
        hotness_of(
            F.col("YOUNG_RATIO"),
            F.col("SHOPPING_TOUR_SUM"),
            F.col("TOTAL_VISITORS"),
            zero_division,
        ),
    )


def annual_hotness(
    counts: DataFrame,
    period: scopes.Period,
    key: str = S.PLACE,
    name: str = "ANNUAL_HOTNESS",
    zero_division: str = "ieee",
) -> DataFrame:
    """Row-level HOTNESS summed over the period."""
    return group_totals(hotness_rows(counts, period, zero_division), key, {name: "HOTNESS"})


def row_features(counts: DataFrame, period: scopes.Period) -> DataFrame:
    """Flag, sums, ratios, roots and logarithm of every row in the hotness scope."""
    return (
        add_row_sums(scopes.hotness_scope(period).apply(counts), VISITORS)
        .withColumn("PURPOSE_FLAG", flag(is_shop_tour()))
        .withColumn("SHOPPING_TOUR_VISITORS", F.col("PURPOSE_FLAG") * F.col("TOTAL_VISITORS"))
        .withColumns(
            {
                "SHOPPING_TOUR_RATIO": eps_ratio("SHOPPING_TOUR_VISITORS", "TOTAL_VISITORS"),
                "YOUNG_RATIO": eps_ratio("YOUNG_VISITORS", "TOTAL_VISITORS"),
            }
        )
        .withColumns(
            {
                "YOUNG_RATIO_4TH_ROOT": fourth_root("YOUNG_RATIO"),
                "SHOPPING_TOUR_RATIO_SQRT": F.pow("SHOPPING_TOUR_RATIO", F.lit(0.5)),
                "LOG_TOTAL_VISITORS": F.log1p("TOTAL_VISITORS"),
            }
        )
        .withColumn(
            "COMBINED_RATIO", F.col("YOUNG_RATIO_4TH_ROOT") * F.col("SHOPPING_TOUR_RATIO_SQRT")
        )
    )


def young_visitor_rows(counts: DataFrame, period: scopes.Period) -> DataFrame:
    """Rows of the visit scope with young and total visitors and their ratio."""
    rows = add_row_sums(scopes.visit_scope(period).apply(counts), VISITORS)
    return rows.withColumn("YOUNG_RATIO", eps_ratio("YOUNG_VISITORS", "TOTAL_VISITORS"))


def young_ratio(counts: DataFrame, period: scopes.Period, key: str = S.PLACE) -> DataFrame:
    """HOTNESS1: share of visitors aged 20 to 39."""
    totals = group_totals(
        young_visitor_rows(counts, period),
        key,
        {"ANNUAL_YOUNG": "YOUNG_VISITORS", "ANNUAL_TOTAL": "TOTAL_VISITORS"},
    )
    return totals.withColumn("ANNUAL_YOUNG_RATIO", eps_ratio("ANNUAL_YOUNG", "ANNUAL_TOTAL"))


def with_hotness2(totals: DataFrame, zero_division: str = "ieee") -> DataFrame:
    """``√shop_young / √young · ln(total + 1e6)`` on group totals."""
    return totals.withColumns(
        {
            "FRAC_SHOP_YOUNG": ieee_divide(
                F.sqrt("ANNUAL_SHOP_YOUNG"), F.sqrt("ANNUAL_YOUNG"), zero_division
            ),
            "LOG_TOTAL_PLUS1e6": offset_log("ANNUAL_TOTAL", HOTNESS2_LOG_OFFSET),
        }
    ).withColumn("HOTNESS2", F.col("FRAC_SHOP_YOUNG") * F.col("LOG_TOTAL_PLUS1e6"))


def young_shop_tour(
    counts: DataFrame, period: scopes.Period, key: str = S.PLACE, zero_division: str = "ieee"
) -> DataFrame:
    """HOTNESS2: young shopping and tourism against all young visitors."""
    rows = young_visitor_rows(counts, period).withColumn(
        "ROW_SHOP_YOUNG", value_when(is_shop_tour(), "YOUNG_VISITORS", otherwise=None)
    )
    totals = group_totals(
        rows,
        key,
        {
            "ANNUAL_SHOP_YOUNG": "ROW_SHOP_YOUNG",
            "ANNUAL_YOUNG": "YOUNG_VISITORS",
            "ANNUAL_TOTAL": "TOTAL_VISITORS",
        },
    )
    return with_hotness2(totals, zero_division)


def with_root_share(
    totals: DataFrame, part: str, whole: str, name: str, zero_division: str = "ieee"
) -> DataFrame:
    """``√part / √whole`` on group totals."""
    return totals.withColumn(name, ieee_divide(F.sqrt(part), F.sqrt(whole), zero_division))


def women_share(
    counts: DataFrame, period: scopes.Period, key: str = S.PLACE, zero_division: str = "ieee"
) -> DataFrame:
    """HOTNESS3: weekend share of women aged 20 to 39, as a ratio of roots."""
    rows = add_row_sums(
        scopes.women_scope(period).apply(counts),
        {"part": S.WOMEN_2039_COLS, "whole": S.COUNT_COLS},
    )
    totals = group_totals(rows, key, {"ANNUAL_FEML2030": "part", "ANNUAL_WEEKEND_TOTAL": "whole"})
    return with_root_share(
        totals, "ANNUAL_FEML2030", "ANNUAL_WEEKEND_TOTAL", "HOTNESS3", zero_division
    )


def teens_twenties_share(
    counts: DataFrame, period: scopes.Period, key: str = S.PLACE, zero_division: str = "ieee"
) -> DataFrame:
    """HOTNESS4: weekend-evening share of ages 10 to 29, as a ratio of roots."""
    rows = add_row_sums(
        scopes.teens_scope(period).apply(counts),
        {"part": S.TEENS_TWENTIES_COLS, "whole": S.COUNT_COLS},
    )
    totals = group_totals(rows, key, {"ANNUAL_1020": "part", "ANNUAL_WEEKEND_TOTAL": "whole"})
    return with_root_share(
        totals, "ANNUAL_1020", "ANNUAL_WEEKEND_TOTAL", "HOTNESS4", zero_division
    )
