"""Missing-value, consistency and outlier checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveatlas.functions.scalar import parse_ymd, to_int
from moveatlas.operators.aggregates import exact_quantiles
from moveatlas.operators.lookups import attach_lookup


def quality_report(
    moves: DataFrame,
    measures: Sequence[str],
    purposes: DataFrame | None = None,
    codes: DataFrame | None = None,
) -> DataFrame:
    """Counts of rows that fail each check, as (check, failures), in one pass.

    ``purposes`` (purpose_code) and ``codes`` (code) are the known codes; a code that is
    given but not among them fails ``unknown_*``. Each list names a code once.
    """
    columns = moves.columns
    lists = {"purpose_code": (purposes, "purpose_code")}
    lists |= {c: (codes, "code") for c in ("o_admdong_cd", "d_admdong_cd")}
    unknown = {}
    for c, (known, key) in lists.items():
        if known is not None:
            flag = f"__known_{c}"
            moves = attach_lookup(moves, known.select(key, F.lit(True).alias(flag)), key, c)
            unknown[f"unknown_{c}"] = F.col(c).isNotNull() & F.col(flag).isNull()
    hour = to_int("st_time_cd", strict=False)
    checks = {f"null_{c}": F.col(c).isNull() for c in columns}
    checks |= {f"negative_{c}": F.col(c) < 0 for c in measures}
    checks["bad_date"] = F.col("etl_ymd").isNotNull() & parse_ymd("etl_ymd", strict=False).isNull()
    checks["bad_hour"] = F.col("st_time_cd").isNotNull() & ~F.coalesce(
        hour.between(0, 23), F.lit(False)
    )
    checks |= unknown
    counted = moves.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(failed).alias(name) for name, failed in checks.items()),
    )
    return counted.unpivot([], counted.columns, "check", "failures")


def iqr_outliers(
    df: DataFrame, column: str, reach: float = 1.5, exact: bool = False
) -> DataFrame:
    """Bounds ``q1 - reach·iqr`` and ``q3 + reach·iqr`` and the rows outside them.

    Approximate quartiles come from one mergeable sketch and suit row-level
    frames; exact ones are a distributed sort of the distinct values.
    """
    if exact:
        ends = exact_quantiles(df, column, {"q1": 0.25, "q3": 0.75})
    else:
        ends = df.agg(
            F.percentile_approx(column, 0.25).alias("q1"),
            F.percentile_approx(column, 0.75).alias("q3"),
        )
    gap = F.lit(reach) * (F.col("q3") - F.col("q1"))
    bounds = ends.select(F.struct((F.col("q1") - gap).alias("lo"), (F.col("q3") + gap).alias("hi")))
    tagged = df.select(F.col(column).alias("v"), bounds.scalar().alias("b"))
    return tagged.agg(
        F.max("b.lo").alias("lower"),
        F.max("b.hi").alias("upper"),
        F.count_if(F.col("v") < F.col("b.lo")).alias("below"),
        F.count_if(F.col("v") > F.col("b.hi")).alias("above"),
    )
