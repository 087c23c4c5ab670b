"""Grouped totals, means and whole-frame statistics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moveatlas.functions.scalar import eps_ratio, zero_sum
from moveatlas.operators.ranking import top_k
from moveatlas.session import shared_folder


def _keys(keys: str | Iterable[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def group_totals(
    df: DataFrame, keys: str | Iterable[str], totals: Mapping[str, Column | str]
) -> DataFrame:
    """Grouped sums, 0.0 for a group without values; partial sums run map-side."""
    return df.groupBy(*_keys(keys)).agg(
        *(zero_sum(value).alias(name) for name, value in totals.items())
    )


def group_means(
    df: DataFrame, keys: str | Iterable[str], means: Mapping[str, Column | str]
) -> DataFrame:
    """Grouped means over the values that are not null."""
    return df.groupBy(*_keys(keys)).agg(
        *(F.avg(value).alias(name) for name, value in means.items())
    )


def _value_positions(df: DataFrame, column: str, wanted: Sequence[Column]) -> DataFrame:
    """Distinct values near the wanted positions, with their last position.

    Copies of a value are counted before anything is sorted, so a value that
    fills a third of the frame is one row here. The sorted values are written
    once to the checkpoint folder; partition totals, one row per partition,
    turn positions inside a partition into positions in the frame. Only
    partitions that hold a wanted position are read again; every row carries the
    totals of the whole frame: rows, sum, low and high.
    """
    shared_folder(df.sparkSession)
    values = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .orderBy("value")
        .checkpoint()
        .withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    parts = (
        values.groupBy("part")
        .agg(
            F.sum("copies").alias("size"),
            F.sum(F.col("value") * F.col("copies")).alias("sum"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        .select(
            "part",
            "size",
            F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
            F.sum("size").over(whole).alias("rows"),
            F.sum("sum").over(whole).alias("sum"),
            F.min("low").over(whole).alias("low"),
            F.max("high").over(whole).alias("high"),
        )
    )
    holds = ((F.col("start") < p) & (p <= F.col("start") + F.col("size")) for p in wanted)
    parts = parts.filter(reduce(lambda a, b: a | b, holds)).drop("size")
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return values.join(F.broadcast(parts), "part").select(
        "value", "rows", "sum", "low", "high", (F.col("start") + F.sum("copies").over(inside)).alias("upto")
    )


def _value_at(position: Column) -> Column:
    """Aggregate: the value at a 1-based position of the sorted frame."""
    return F.min(F.when(F.col("upto") >= position, F.col("value")))


def _nearest(q: float) -> Column:
    return F.floor((F.col("rows") - 1) * F.lit(float(q)) + F.lit(0.5)) + 1


def exact_quantiles(
    df: DataFrame, column: str, quantiles: Mapping[str, float], method: str = "nearest"
) -> DataFrame:
    """Exact quantiles of a column in one row, nulls left out.

    ``nearest`` takes the value at index ``round((n - 1) * q)``, halves rounded
    up; ``linear`` interpolates between the two neighbours. The work is a
    distributed sort, for frames of any size.
    """
    if method not in ("nearest", "linear"):
        raise ValueError(f"method must be 'nearest' or 'linear', not {method!r}")
    picked, wanted = [], []
    for name, q in quantiles.items():
        if method == "nearest":
            wanted.append(_nearest(q))
            picked.append(_value_at(_nearest(q)).alias(name))
            continue
        index = (F.col("rows") - 1) * F.lit(float(q))
        ends = F.floor(index) + 1, F.ceil(index) + 1
        wanted += ends
        low, high = map(_value_at, ends)
        weight = F.max(index - F.floor(index))
        picked.append((low + (high - low) * weight).alias(name))
    return _value_positions(df, column, wanted).agg(*picked)


def summary_stats(df: DataFrame, column: str, quartiles: bool = True) -> DataFrame:
    """Mean, median, min, max and, if asked, nearest quartiles, in one row.

    Everything is read off one distributed sort of the value counts, so no task
    holds all values and the frame is computed once.
    """
    rows = F.col("rows")
    middle = F.floor((rows + 1) / 2), F.floor((rows + 2) / 2)
    wanted = [*middle]
    picked = [
        F.max(F.col("sum") / rows).alias("mean"),
        ((_value_at(middle[0]) + _value_at(middle[1])) / F.lit(2.0)).alias("median"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
    ]
    for name, q in (("q1", 0.25), ("q3", 0.75)) if quartiles else ():
        wanted.append(_nearest(q))
        picked.append(_value_at(_nearest(q)).alias(name))
    return _value_positions(df, column, wanted).agg(*picked)


def top_k_stats(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """Mean and median over the k best groups, at most k rows."""
    return top_k(df, by, key, k).agg(
        F.avg(by).alias("mean"), F.median(by).alias("median")
    )


def count_zero(df: DataFrame, column: str, name: str = "zero_count") -> DataFrame:
    return df.agg(F.count_if(F.col(column) == 0).alias(name))


def min_positive(df: DataFrame, column: str, name: str = "min_positive") -> DataFrame:
    """Smallest value above zero as a one-row frame; null when there is none."""
    return df.agg(F.min(F.when(F.col(column) > 0, F.col(column))).alias(name))


def band_mix(
    df: DataFrame, keys: str | Iterable[str], bands: Sequence[str], more: Mapping[str, str] | None = None
) -> DataFrame:
    """Grouped total and share of each age band; shares are of the band sum.

    ``more`` names further totals of the same pass.
    """
    totals = group_totals(df, keys, {**{f"total_{band}": band for band in bands}, **(more or {})})
    whole = sum((F.col(f"total_{band}") for band in bands[1:]), F.col(f"total_{bands[0]}"))
    return totals.withColumns(
        {f"share_{band}": eps_ratio(f"total_{band}", whole) for band in bands}
    )


def monthly_means(
    df: DataFrame, keys: str | Iterable[str], month: Column, bands: Sequence[str]
) -> DataFrame:
    """Mean of the monthly totals per group and band, with a linear trend per month.

    ``month`` is an integer ``yyyyMM``. Months without rows are not counted.
    The trend is the least-squares slope of the monthly totals over calendar
    months, null when a group has a single month.
    """
    keys = _keys(keys)
    monthly = group_totals(
        df.withColumn("__month", month), [*keys, "__month"], {band: band for band in bands}
    )
    step = (F.floor(F.col("__month") / 100) * 12 + F.col("__month") % 100).cast("double")
    return monthly.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"),
        *(F.avg(band).alias(f"mean_{band}") for band in bands),
        *(F.regr_slope(F.col(band), step).alias(f"trend_{band}") for band in bands),
    )


def month_index(month: int) -> int:
    """Months since year 0 of an integer ``yyyyMM``."""
    if not 1 <= month % 100 <= 12:
        raise ValueError(f"no such month: {month}")
    return month // 100 * 12 + month % 100 - 1


def period_means(
    df: DataFrame, keys: str | Iterable[str], month: Column, bands: Sequence[str], period: tuple[int, int]
) -> DataFrame:
    """Mean monthly total and trend per group and band over all months of a period.

    ``period`` is an inclusive range ``yyyyMM``. Unlike ``monthly_means``, a month without
    rows counts as 0. Such months add nothing to the sums that mean and slope are made
    of, and their number is known, so no row per month is made. The trend is null for a
    period of one month; ``months`` counts the months that have rows.
    """
    keys = _keys(keys)
    first, last = map(month_index, period)
    n = last - first + 1
    if n < 1:
        raise ValueError(f"empty period: {period}")
    monthly = group_totals(
        df.withColumn("__month", month).filter(F.col("__month").between(*period)),
        [*keys, "__month"],
        {band: band for band in bands},
    )
    step = F.floor(F.col("__month") / 100) * 12 + F.col("__month") % 100 - 1 - first
    steps, squares = sum(range(n)), sum(i * i for i in range(n))
    spread = squares - steps * steps / n

    def slope(band: str) -> Column:
        if n == 1:
            return F.lit(None).cast("double")
        return (F.sum(step * F.col(band)) - F.lit(steps / n) * F.sum(band)) / F.lit(spread)

    return monthly.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"),
        *((F.sum(band) / F.lit(float(n))).alias(f"mean_{band}") for band in bands),
        *(slope(band).alias(f"trend_{band}") for band in bands),
    )
