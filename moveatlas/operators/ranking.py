"""Sorting, top-k and positional ranks.

Sort order puts nulls first and NaN as the largest value in both directions;
the key column breaks ties, so every order is total and repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moveatlas.session import shared_folder


def sort_order(by: str, key: str | tuple[str, ...], ascending: bool = False) -> list[Column]:
    keys = (key,) if isinstance(key, str) else key
    first = F.asc_nulls_first(by) if ascending else F.desc_nulls_first(by)
    return [first, *(F.asc_nulls_first(k) for k in keys)]


def sort_rows(df: DataFrame, by: str, key: str | tuple[str, ...], ascending: bool = False) -> DataFrame:
    return df.orderBy(*sort_order(by, key, ascending))


def top_k(
    df: DataFrame, by: str, key: str | tuple[str, ...], k: int, ascending: bool = False
) -> DataFrame:
    """The first k rows in sort order; each task keeps only k rows."""
    return sort_rows(df, by, key, ascending).limit(k)


def top_ranked(
    df: DataFrame,
    by: str,
    key: str | tuple[str, ...],
    k: int,
    ascending: bool = False,
    rank: str = "RANK",
) -> DataFrame:
    """Top k with a 1-based position; the ranking window sees at most k rows."""
    window = Window.orderBy(*sort_order(by, key, ascending))
    return top_k(df, by, key, k, ascending).withColumn(
        rank, F.row_number().over(window).cast("long")
    )


def rank_rows(
    df: DataFrame,
    by: str,
    key: str | tuple[str, ...],
    ascending: bool = False,
    rank: str = "RANK",
) -> DataFrame:
    """1-based position of every row, for frames of any size.

    The frame is range-sorted and written once to the checkpoint folder, which
    fixes its partitions. A row's position is its index inside its partition
    plus the number of rows in the partitions before it; that offset table has
    one row per partition, so broadcasting it is bounded. No task ever holds
    more than one sorted partition.
    """
    shared_folder(df.sparkSession)
    ordered = sort_rows(df, by, key, ascending).checkpoint()
    numbered = ordered.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    index = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.select(*df.columns, part.alias("__part"), index.alias("__index"))
    starts = (
        numbered.groupBy("__part")
        .count()
        .select(
            "__part",
            F.coalesce(
                F.sum("count").over(
                    Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("__start"),
        )
    )
    return numbered.join(F.broadcast(starts), "__part").select(
        *df.columns, (F.col("__start") + F.col("__index") + 1).alias(rank)
    )


def preview(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Any n rows, unsorted; which ones is not defined."""
    return df.select(*columns).limit(n)


PRE_LIMIT_SALTS = 64


def top_n_per_group(
    df: DataFrame,
    group: str | tuple[str, ...],
    by: str,
    key: str | tuple[str, ...],
    n: int,
    rank: str = "RANK",
) -> DataFrame:
    """The first n rows of each group with their position.

    The rank filter sits on the window, so Spark drops all but n rows per group
    in every map task before the shuffle; a hot group stays small. Spark does
    so only up to a threshold of n; above it, each group is first cut to n rows
    per salt of the key, so that again no task receives a whole hot group.
    """
    groups = (group,) if isinstance(group, str) else group
    keys = (key,) if isinstance(key, str) else key
    order = sort_order(by, key)

    def cut(frame: DataFrame, *parts) -> DataFrame:
        window = Window.partitionBy(*parts).orderBy(*order)
        return frame.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)

    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > threshold:
        salt = F.pmod(F.xxhash64(*keys), F.lit(PRE_LIMIT_SALTS))
        df = cut(df, *groups, salt).drop(rank)
    return cut(df, *groups).withColumn(rank, F.col(rank).cast("long"))
