"""Mixing sources to target weights by nested hash-threshold histograms.

Every document has a keyed hash of its id. Words are summed by source and leading
hash bits; the bucket in which a source's budget runs out is found, and only that
bucket is refined by the next bits, until the threshold is one hash value. The mix
is then a filter ``hash < threshold``: nothing is sorted, and a rerun or another
partitioning gives the same documents. The last hash value is taken or left,
whichever ends nearer to the budget.

Targets share all words by weight (1, 2, 3 repeating over the sources in code point
order, null last). A source gets at most three times its own words; the rest is
shared among the others by weight until none is above. Whole passes over a source
come first, and the remainder is drawn by the threshold.

Defined cases: a null or empty text has size 0; rows of one id, or without an id,
share a hash and are taken or left together; a source without words has target 0;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moveatlas.llm.text import WORD, present, stored, with_hint

HASH_BITS = 60
LEVEL_BITS = 12
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(present(text), F.lit(WORD)).cast("long")


def mix_hash(key: Column, seed: str = SEED) -> Column:
    """The leading 60 bits of the MD5 of seed and key."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")


def with_sizes(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: str = SEED
) -> DataFrame:
    """Add ``size`` (words) and ``mix_hash``; columns of these names are replaced."""
    return docs.withColumns(
        {"size": word_count(F.col(text)), "mix_hash": mix_hash(F.col(key), seed)}
    )


def source_targets(
    sized: DataFrame,
    *,
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """source, source_size, target: one row per source.

    Sources reach their caps in the order of cap / weight; the level (words per unit
    of weight) is the first at which the next source stays below its cap. The
    windows run over one row per source.
    """
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = totals.withColumns(
        {
            "weight": F.get(
                F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights)
            ),
            "cap": F.col("source_size") * max_repeats,
        }
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = named.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / F.sum("weight").over(rest),
    )
    level = F.first(
        F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True
    ).over(whole)
    return levelled.withColumn("final", level).select(
        "source",
        "source_size",
        F.least(F.col("final") * F.col("weight"), F.col("cap").cast("double")).alias("target"),
    )


def thresholds(sized: DataFrame, targets: DataFrame, *, source: str = "source") -> DataFrame:
    """targets plus passes, threshold and take_equal: which hashes the remainder takes.

    ``sized`` is read once per level, but after the first level only the rows of each
    source's boundary bucket are summed.
    """
    rows = sized.select(F.col(source).alias("source"), F.col("mix_hash").alias("h"), "size")
    size = F.col("source_size")
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    bounds = targets.withColumn("passes", passes).withColumns(
        {
            "budget": F.col("target") - F.col("passes") * size,
            "prefix": F.lit(0).cast("long"),
            "base": F.lit(0).cast("long"),
        }
    )
    bounds = stored(bounds, "mix-targets")
    kept = [c for c in bounds.columns if c not in ("source", "prefix", "base")]
    for left in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bound = with_hint(bounds.alias("b"))
        inside = F.shiftright(F.col("h"), left + LEVEL_BITS) == F.col("b.prefix")
        joined = rows.alias("r").join(bound, F.col("r.source").eqNullSafe(F.col("b.source")) & inside)
        buckets = joined.groupBy(
            F.col("b.source").alias("source"),
            *[F.col(f"b.{c}").alias(c) for c in kept],
            F.col("b.base").alias("base"),
            F.shiftright(F.col("h"), left).alias("prefix"),
        ).agg(F.sum("size").alias("here"))
        along = Window.partitionBy("source").orderBy("prefix")
        summed = buckets.withColumn("upto", F.col("base") + F.sum("here").over(along))
        over = summed.where(F.col("upto") > F.col("budget"))
        first = over.withColumn("n", F.row_number().over(along)).where(F.col("n") == 1)
        found = first.select(
            "source", *kept, "prefix", (F.col("upto") - F.col("here")).alias("base"), "here"
        )
        bounds = stored(found, "mix-bounds")
    nearer = 2 * (F.col("budget") - F.col("base")) > F.col("here")
    last = bounds.select(
        "source", F.col("prefix").alias("threshold"), nearer.alias("take_equal")
    )
    both = targets.withColumn("passes", passes).alias("t").join(
        last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left"
    )
    return both.select("t.*", "l.threshold", "l.take_equal")


def mix_sources(
    docs: DataFrame,
    sized: DataFrame,
    *,
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """``docs`` (with ``size`` and ``mix_hash``) plus source_size, target, copies, taken.

    ``sized`` holds source, size and mix_hash of the same documents and is read
    several times; give a stored projection of ``docs``. Columns of the added names
    are replaced.
    """
    targets = stored(source_targets(sized, source=source, weights=weights, max_repeats=max_repeats), "mix-sources")
    plan = stored(thresholds(sized, targets, source=source), "mix-plan")
    added = ("source_size", "target", "copies", "taken")
    d = docs.drop(*added).alias("d")
    p = with_hint(plan.select("source", "source_size", "target", "passes", "threshold", "take_equal").alias("p"))
    joined = d.join(p, F.col(f"d.{source}").eqNullSafe(F.col("p.source")), "left")
    h = F.col("d.mix_hash")
    extra = (h < F.col("p.threshold")) | ((h == F.col("p.threshold")) & F.col("p.take_equal"))
    drawn = F.col("p.passes") + F.coalesce(extra, F.lit(False)).cast("long")
    copies = F.least(drawn, F.lit(max_repeats).cast("long"))
    return joined.select(
        "d.*", "p.source_size", "p.target", copies.alias("copies"),
        (copies * F.col("d.size")).alias("taken"),
    )
