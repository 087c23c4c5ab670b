"""An indicator mart that is kept up batch by batch.

Every batch of counts leaves its partial totals by month and group in a folder of its
own. Partial totals only add up, so late rows of an old month are one more small row and
no stored row is touched; a batch that runs again replaces its own folder. Reading adds
up the partial totals of the wanted months: history is never scanned again.
``compact`` replaces many batches by one once they have grown in number.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moveatlas import schema as S
from moveatlas.plans.mart import SCOPE_NAMES, TOTALS, monthly_mart, roll_up
from moveatlas.streaming.ingest import stream_counts_csv

KEYS = (S.PROVINCE, S.DISTRICT, S.PLACE)
BATCH_COL = "batch"


def mart_schema(keys: tuple[str, ...] = KEYS) -> str:
    """Columns of the stored partial totals; the batch is the folder."""
    columns = [f"`{k}` string" for k in keys] + [f"`{S.MONTH_COL}` int"]
    columns += [f"rows_{name} bigint" for name in SCOPE_NAMES] + [f"{name} double" for name in TOTALS]
    return ", ".join(columns)


def write_batch(counts: DataFrame, path: str, batch: str, keys: tuple[str, ...] = KEYS) -> None:
    """Store the partial totals of one batch of standardised counts, replacing an earlier try."""
    totals = monthly_mart(counts, keys)
    totals.write.mode("overwrite").parquet(f"{path}/{BATCH_COL}={batch}")


def read_mart(
    spark: SparkSession, path: str, months: tuple[int, int], keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """The mart of an inclusive range of months ``yyyyMM``, as ``indicator_mart`` gives it.

    ``keys`` may be fewer than the stored ones.
    """
    stored = spark.read.schema(f"{mart_schema()}, `{BATCH_COL}` string").parquet(path)
    return roll_up(stored.filter(F.col(S.MONTH_COL).between(*months)), keys)


def keep_mart(
    spark: SparkSession, src: str, path: str, progress: str, files_per_batch: int | None = None, strict: bool = True
) -> StreamingQuery:
    """Add every CSV file not seen before to the mart, in bounded batches, then stop.

    Batches are named after ``progress`` and their number, so a repeated batch adds nothing.
    """
    run = hashlib.md5(progress.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        write_batch(batch, path, f"{run}-{number}")

    return (
        stream_counts_csv(spark, src, files_per_batch, strict)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the totals of all batches as the only batch of a new mart.

    Switch readers to ``to`` when it is complete; batches that run again belong to the
    mart they were first written to.
    """
    stored = spark.read.schema(f"{mart_schema()}, `{BATCH_COL}` string").parquet(path)
    together = roll_up(stored, (*KEYS, S.MONTH_COL))
    together.write.mode("errorifexists").parquet(f"{to}/{BATCH_COL}=compacted")
