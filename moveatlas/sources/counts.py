"""Purpose counts: CSV ingest, Parquet layout and scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moveatlas import schema as S
from moveatlas.functions.scalar import month_number, parse_ymd, to_double, to_int


#: A header that does not match the schema is an error, in batch and in streams.
CSV_OPTIONS = {"header": True, "enforceSchema": False}


def read_counts_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with every column as text; a header that does not match is an error."""
    return spark.read.schema(S.COUNTS_TEXT_SCHEMA).options(**CSV_OPTIONS).csv(path)


def add_date(df: DataFrame, strict: bool = True) -> DataFrame:
    """Add the parsed date beside the ``yyyyMMdd`` text."""
    return df.withColumn(S.DATE_COL, parse_ymd("ETL_YMD", strict))


def standardise_counts(df: DataFrame, strict: bool = True) -> DataFrame:
    """Cast once: date, integer hour and month, double counts; texts are kept."""
    return add_date(df, strict).withColumns(
        {
            S.HOUR_COL: to_int("TIME_CD", strict),
            S.MONTH_COL: month_number("ETL_YMD", strict),
            **{c: to_double(c, strict) for c in (*S.COUNT_COLS, "TOTAL_CNT")},
        }
    )


def remove_files(spark: SparkSession, pattern: str) -> None:
    """Delete the files that a path pattern names, in whatever store the path is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in store.globStatus(path) or ():
        store.delete(found.getPath(), False)


def write_by_month(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    month: str = S.MONTH_COL,
    file_prefix: str | None = None,
) -> None:
    """Write Parquet partitioned by month.

    The rebalance hint brings the rows of a month together, splits a month that
    is too large for one task and merges small ones, so files have an even size
    and one hot month does not land in one task. Inside a file rows are sorted by
    place, so that a query for one place skips row groups. ``file_prefix`` starts the
    names of the files.
    """
    order = [c for c in (S.PROVINCE, S.DISTRICT, S.PLACE, S.DATE_COL) if c in df.columns]
    even = df.hint("rebalance", month)
    if order:
        even = even.sortWithinPartitions(month, *order)
    writer = even.write.mode(mode).partitionBy(month)
    if file_prefix is not None:
        writer = writer.option("mapreduce.output.basename", file_prefix)
    writer.parquet(path)


def ingest_csv_to_parquet(
    spark: SparkSession, src: str | list[str], dst: str, mode: str = "errorifexists", strict: bool = True
) -> DataFrame:
    """CSV to month-partitioned, typed Parquet; returns a scan of the result."""
    write_by_month(standardise_counts(read_counts_csv(spark, src), strict), dst, mode)
    return scan_counts(spark, dst)


def scan_counts(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Lazy scan of one Parquet file or a tree of them.

    ``recursive`` reads every file below a plain directory tree; leave it off
    for month-partitioned data, where it would hide the partition column.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.parquet(path)


def load_columns(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Only the needed columns of many Parquet inputs."""
    return spark.read.parquet(*paths).select(*columns)


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header for dashboards; a small aggregated frame gives one file."""
    df.write.mode(mode).option("header", True).csv(path)


def write_all_extracts(
    df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 5_000_000
) -> None:
    """Parquet of the extracts of all places, one folder a side, sorted by place.

    Places are dealt in ranges over tasks, so the number of files follows the size and
    not the number of places; a place is read from the row groups whose range holds it.
    """
    ranged = df.repartitionByRange("side", "place", "RANK").sortWithinPartitions("side", "place", "RANK")
    writer = ranged.write.mode(mode).partitionBy("side").option("maxRecordsPerFile", rows_per_file)
    writer.option("parquet.bloom.filter.enabled#place", True).parquet(path)


def write_extract(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet extract of one place."""
    df.write.mode(mode).parquet(path)
