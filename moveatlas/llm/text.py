"""Small Column helpers and stored intermediate tables shared by the operators."""

from __future__ import annotations

import string
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moveatlas.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BROADCAST_ROWS = 1_000_000


def present(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space; none for null."""
    return F.filter(F.split(present(text), SPACE), lambda w: w != "")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation of text work;
    the file stays until the folder is cleared.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_hint(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows stay within a bound."""
    return F.broadcast(small) if small.count() <= max_rows else small


def ship(module: str) -> None:
    """Send a module's functions with the tasks; executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def apart(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``work`` with columns of its working names set aside; keep the columns of ``docs``."""
    aside = {c: f"__aside_{c}" for c in docs.columns if c in names}
    done = work(docs.withColumnsRenamed(aside))
    return done.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
