"""Incremental CSV ingest: new files in, month-partitioned Parquet out."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from moveatlas import schema as S
from moveatlas.sources.counts import CSV_OPTIONS, remove_files, standardise_counts, write_by_month


def stream_counts_csv(
    spark: SparkSession, src: str, files_per_batch: int | None = None, strict: bool = True
) -> DataFrame:
    """CSV folder as a stream of standardised counts."""
    reader = spark.readStream.schema(S.COUNTS_TEXT_SCHEMA).options(**CSV_OPTIONS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return standardise_counts(reader.csv(src), strict)


def ingest_new_files(
    spark: SparkSession,
    src: str,
    dst: str,
    progress: str,
    files_per_batch: int | None = None,
    strict: bool = True,
) -> StreamingQuery:
    """Write every file not ingested before, in bounded batches, then stop.

    ``progress`` is the folder that remembers ingested files; a run that fails
    or repeats neither loses nor doubles a file: the files of a batch are named after
    it, and a batch that runs again first removes what its last attempt left. Batches
    have the layout of ``write_by_month``, so later batch appends are read with them.
    """
    run = hashlib.md5(progress.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        name = f"ingest-{run}-{number}"
        remove_files(batch.sparkSession, f"{dst}/{S.MONTH_COL}=*/{name}-*")
        write_by_month(batch, dst, "append", file_prefix=name)

    return (
        stream_counts_csv(spark, src, files_per_batch, strict)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
