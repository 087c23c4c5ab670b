"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage
before it kept; its result is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moveatlas.llm import decontaminate, line_dedup, mixing, quality_rules, simhash
from moveatlas.llm.text import apart, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.fit_rules(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source; n_chars follows."""
    cut = apart(docs, ("n_lines", "n_dropped"), line_dedup.drop_boilerplate)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of fingerprints: four-word shingles, four bits or fewer."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies and words taken."""
    sized = mixing.with_sizes(docs)
    counts = stored(sized.select("source", "size", "mix_hash"), "pipeline-sizes")
    mixed = mixing.mix_sources(sized, counts).where(F.col("copies") > 0)
    return mixed.drop("mix_hash")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("mixing", mix),
]

#: The learned list and the fingerprints have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
