"""Origin-destination moves: standardising, merging and storage layout."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveatlas import schema as S
from moveatlas.functions.scalar import month_number, parse_ymd, to_double, to_int
from moveatlas.operators.lookups import reconcile_admin_codes
from moveatlas.sources.counts import CSV_OPTIONS, write_by_month


def standardise_moves(df: DataFrame, strict: bool = True) -> DataFrame:
    """Add the parsed date; make start and end hours integers."""
    return df.withColumns(
        {
            S.MOVE_DATE_COL: parse_ymd("etl_ymd", strict),
            "st_time_cd": to_int("st_time_cd", strict),
            "fns_time_cd": to_int("fns_time_cd", strict),
        }
    )


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Stack sources by column name; a column a source lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_moves(
    sources: list[DataFrame], history: DataFrame, path: str, mode: str = "errorifexists", strict: bool = True
) -> DataFrame:
    """Merge sources, bring admin codes up to date, write one monthly dataset.

    A bad month is an error when strict; otherwise its rows are kept in the null month.
    """
    merged = reconcile_admin_codes(union_by_name(sources), history)
    merged = merged.withColumn(S.MOVE_MONTH_COL, month_number("etl_ymd", strict))
    write_by_month(merged, path, mode, S.MOVE_MONTH_COL)
    return merged.sparkSession.read.parquet(path)


def optimise_layout(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    columns: Sequence[str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Write a smaller, better clustered copy of a standardised moves frame.

    Hours become one-byte integers and the date replaces its text. Rows are
    rebalanced by month and sorted by destination, origin and date inside each
    task, so codes run-length encode and row groups prune by place. Counts keep
    double precision: results must not change. ``columns`` names the columns to keep
    besides date and month; by default all stay. Bad dates or hours are errors when
    strict, null otherwise.
    """
    narrow = standardise_moves(df, strict) if dict(df.dtypes).get(S.MOVE_DATE_COL) != "date" else df
    if S.MOVE_MONTH_COL not in narrow.columns:
        narrow = narrow.withColumn(S.MOVE_MONTH_COL, month_number("etl_ymd", strict))
    narrow = narrow.withColumns(
        {c: F.col(c).cast("tinyint") for c in ("st_time_cd", "fns_time_cd") if c in narrow.columns}
    ).drop("etl_ymd")
    if columns is not None:
        always = [c for c in (S.MOVE_DATE_COL, S.MOVE_MONTH_COL) if c not in columns]
        narrow = narrow.select(*(c for c in columns if c != "etl_ymd"), *always)
    order = [c for c in ("d_admdong_cd", "o_admdong_cd") if c in narrow.columns]
    (
        narrow.hint("rebalance", S.MOVE_MONTH_COL)
        .sortWithinPartitions(S.MOVE_MONTH_COL, *order, S.MOVE_DATE_COL)
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy(S.MOVE_MONTH_COL)
        .parquet(path)
    )
    return df.sparkSession.read.parquet(path)


def read_moves_csv(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """CSV of moves with the declared types; codes keep leading zeros.

    Everything is read as text, under a header that has to match, and numbers are cast:
    bad text is an error when strict and null otherwise; empty cells are null.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in S.MOVES_SCHEMA])
    rows = spark.read.schema(text).options(**CSV_OPTIONS).csv(path)
    numbers = {
        f.name: to_double(F.col(f"`{f.name}`"), strict) for f in S.MOVES_SCHEMA if f.dataType == T.DoubleType()
    }
    return rows.withColumns(numbers)
