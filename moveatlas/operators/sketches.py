"""Quantiles and outliers from mergeable sketches, and samples that do not depend on partitions.

A KLL sketch (Spark's own aggregate) holds a few hundred values of a column however many
rows there are; sketches of parts merge into the sketch of the whole, so places roll up
to districts and days to years without another scan. Its quantiles come with a bound on
their rank: the value given for q has a true rank within ``rank_error(k)`` of q.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas.operators.ranking import top_n_per_group

K = 400

# The published fit of the normalised rank error of these sketches, which
# holds with a confidence of 99 %: 2.296 / k ** 0.9021.
ERROR_FACTOR = 2.296
ERROR_POWER = 0.9021


def rank_error(k: int = K, times: float = 1.0) -> float:
    """Bound on the rank error of one quantile, as a share of all rows.

    The error is about normal, so ``times=2`` (twice the bound) holds but for about one
    quantile in four million.
    """
    return times * ERROR_FACTOR / k**ERROR_POWER


def quantile_sketches(df: DataFrame, column: str, keys: Iterable[str] = (), k: int = K) -> DataFrame:
    """One row per group: keys, ``rows`` that have a value, ``sketch``. Groups without a value are left out."""
    present = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    sketch = F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k)).alias("sketch")
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), sketch).filter(F.col("rows") > 0)


def merge_sketches(sketches: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch").alias("sketch")
    ).filter(F.col("rows") > 0)


def sketch_quantile(q: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, q))))


def sketch_quantiles(sketches: DataFrame, quantiles: Mapping[str, float]) -> DataFrame:
    """The sketches' rows with a column per wanted quantile, without the sketch."""
    return sketches.withColumns({name: sketch_quantile(q) for name, q in quantiles.items()}).drop("sketch")


def outlier_bounds(sketches: DataFrame, reach: float = 1.5, k: int = K, times: float = 1.0) -> DataFrame:
    """Per group: keys, rows and the interquartile bounds as intervals.

    The bound ``q1 - reach (q3 - q1)`` lies in ``lower_least`` to ``lower_most`` and
    ``q3 + reach (q3 - q1)`` in ``upper_least`` to ``upper_most``, by the rank error.
    """
    error = rank_error(k, times)
    cuts = {f"q{n}_{side}": q + sign * error for n, q in ((1, 0.25), (3, 0.75)) for side, sign in (("lo", -1), ("hi", 1))}
    found = sketch_quantiles(sketches, cuts)
    lo, hi = {n: F.col(f"q{n}_lo") for n in (1, 3)}, {n: F.col(f"q{n}_hi") for n in (1, 3)}
    r = F.lit(reach)
    return found.withColumns(
        {
            "lower_least": lo[1] - r * (hi[3] - lo[1]),
            "lower_most": hi[1] - r * F.greatest(lo[3] - hi[1], F.lit(0.0)),
            "upper_least": lo[3] + r * F.greatest(lo[3] - hi[1], F.lit(0.0)),
            "upper_most": hi[3] + r * (hi[3] - lo[1]),
        }
    ).drop(*cuts)


def sketched_outliers(
    df: DataFrame, column: str, keys: Iterable[str], reach: float = 1.5, k: int = K, times: float = 1.0
) -> DataFrame:
    """Per group: rows, ``certain`` outliers and ``possible`` ones, which include the certain.

    A certain outlier lies outside whatever the sketch's rank error hides, a possible one
    is not ruled out by it; the exact count lies between. Two scans of the frame, one
    sketch and one row of bounds per group.
    """
    keys = list(keys)
    bounds = outlier_bounds(quantile_sketches(df, column, keys, k), reach, k, times)
    named = bounds.withColumnsRenamed({key: f"__{key}" for key in keys}).drop("rows")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__{key}"))
    value = F.col(column).cast("double")
    met = df.filter(value.isNotNull() & ~F.isnan(value)).join(named, same)
    return met.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((value < F.col("lower_least")) | (value > F.col("upper_most"))).alias("certain"),
        F.count_if((value < F.col("lower_most")) | (value > F.col("upper_least"))).alias("possible"),
    )


SAMPLE_CODE = "sample_code"


def hash_sample(
    df: DataFrame, group: str | tuple[str, ...], keys: Iterable[str], n: int, seed: int = 0
) -> DataFrame:
    """n different rows of ``keys`` of every group, the ones with the highest hash.

    Which rows are taken depends on their content and the seed alone: not on partitions,
    order or repeated rows, and the sample of a union is the n best of the parts' samples.
    Keys are compared as text; a null is a text of its own. ``sample_code`` is the hash.
    """
    groups = (group,) if isinstance(group, str) else tuple(group)
    keys = [k for k in keys if k not in groups]
    texts = (F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null")) for k in (*groups, *keys))
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts)).alias(SAMPLE_CODE)
    rows = df.select(*groups, *keys, code).distinct()
    return top_n_per_group(rows, groups, SAMPLE_CODE, SAMPLE_CODE, n).drop("RANK")
