"""Mobility-shaped views over the sales test tables.

No mobility table comes with the test data, so purpose counts and moves are
derived from lineitem, orders, supplier, nation and region. Only narrow key
columns cross the joins; counts are computed above them. Supplier, nation and
region join one by one, so that each has a file size Spark can check before it
chooses to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveatlas import schema as S


_SCHEMAS: dict[str, T.StructType] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; its schema is read from the file footer only once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _trips(spark: SparkSession, sf_dir: str, ymd: tuple[str, str] | None) -> DataFrame:
    """Line items with their order; a known period is cut at the orders scan.

    The day is made text once an order, not once a line item. What is computed from a
    line item is computed above the joins, which so move only its own columns.
    """
    orders = _table(spark, sf_dir, "orders")
    if ymd is not None:
        lo, hi = (f"TIMESTAMP_NTZ '{d[:4]}-{d[4:6]}-{d[6:]}'" for d in ymd)
        orders = orders.filter(f"o_orderdate >= {lo} AND o_orderdate < {hi} + INTERVAL 1 DAY")
    orders = orders.selectExpr("o_orderkey", "o_custkey", "date_format(o_orderdate, 'yyyyMMdd') AS day")
    return _table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


#: The two row parts that the sixteen counts are made of.
_PARTS = ("*", "l_partkey + 1 AS step", "l_linenumber * 7 - 1 AS shift")


def _count(i: int) -> str:
    """``1 + (partkey·(i+1) + linenumber·7 + i) mod 9``, with its row parts shared."""
    return f"1 + (step * {i + 1} + shift) % 9"


# The sixteen counts of a row depend on its two row parts modulo 9 only, so they
# are one of 81 lists of sixteen digits. Sixteen formulas per row instead would
# make the generated method too large for the JVM to compile.
_DIGITS = "element_at(array({}), CAST(1 + step % 9 * 9 + shift % 9 AS INT))".format(
    ", ".join(
        "array(" + ", ".join(f"'{1 + (step * (i + 1) + shift) % 9}'" for i in range(16)) + ")"
        for step in range(9)
        for shift in range(9)
    )
)


_PURPOSE = " ".join(
    [
        f"CASE WHEN l_linenumber IN (1, 2) AND l_suppkey % 20 = 0 THEN '{S.OTHER}'",
        *(f"WHEN l_linenumber = {n} THEN '{p}'" for n, p in enumerate(S.ALL_PURPOSES, 1)),
        "END",
    ]
)


def _hour(value: str) -> str:
    return f"lpad(CAST(({value}) % 24 AS STRING), 2, '0')"


def purpose_counts(
    spark: SparkSession, sf_dir: str, ymd: tuple[str, str] | None = None
) -> DataFrame:
    """Purpose counts, every column text, one row per line item."""
    trips = (
        _trips(spark, sf_dir, ymd)
        .join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return trips.selectExpr(*_PARTS).selectExpr("*", f"{_DIGITS} AS digits").selectExpr(
        "day AS ETL_YMD",
        _hour("CAST(l_quantity AS INT)") + " AS TIME_CD",
        f"{_PURPOSE} AS MOVE_PURPOSE",
        f"r_name AS {S.PROVINCE}",
        f"n_name AS {S.DISTRICT}",
        f"concat(r_name, '_', n_name, '_', s_name) AS {S.PLACE}",
        *(f"digits[{i}] AS {name}" for i, name in enumerate(S.COUNT_COLS)),
        "CAST(l_extendedprice AS STRING) AS TOTAL_CNT",
    )


def moves(spark: SparkSession, sf_dir: str, ymd: tuple[str, str] | None = None) -> DataFrame:
    """Moves from a customer code to a supplier code, one row per line item."""
    index = {name: i for i, name in enumerate(S.COUNT_COLS)}
    bands = [
        "CAST("
        + " + ".join(_count(index[c]) for c in S.count_columns(decades=decades))
        + f" AS DOUBLE) AS `{band}_cnt`"
        for band, decades in S.BAND_DECADES.items()
    ]
    hour = "CAST(l_quantity AS INT)"
    return (
        _trips(spark, sf_dir, ymd)
        .selectExpr(*_PARTS)
        .selectExpr(
            "CAST(o_custkey % 100 AS STRING) AS o_admdong_cd",
            "CAST(l_suppkey AS STRING) AS d_admdong_cd",
            "day AS etl_ymd",
            _hour(hour) + " AS st_time_cd",
            _hour(f"{hour} + l_linenumber") + " AS fns_time_cd",
            "l_extendedprice AS move_dist",
            "l_quantity * 3.0D AS move_time",
            "CAST(l_linenumber AS STRING) AS purpose_code",
            *bands,
            "930000.0D + (o_custkey % 100) * 450.0D AS o_x",
            "1930000.0D + ((o_custkey % 100) * 37 % 100) * 500.0D AS o_y",
            "930000.0D + (l_suppkey % 100) * 450.0D AS d_x",
            "1930000.0D + (l_suppkey * 37 % 100) * 500.0D AS d_y",
            "CAST(l_quantity * 7 + l_linenumber AS DOUBLE) AS total_cnt",
        )
    )


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District of every destination code but those ending in 9, left out on purpose."""
    return (
        _table(spark, sf_dir, "supplier")
        .join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .filter(F.col("s_suppkey") % 10 != 9)
        .selectExpr("CAST(s_suppkey AS STRING) AS d_admdong_cd", "n_name AS district")
    )


def purpose_map(spark: SparkSession) -> DataFrame:
    """Purpose labels by code, with the last code left out on purpose."""
    return spark.createDataFrame(
        [(str(i), p) for i, p in enumerate(S.ALL_PURPOSES, 1) if p != S.TO_SCHOOL],
        "purpose_code string, purpose string",
    )


def code_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented code changes over supplier keys.

    By last digit: 3 is transferred to 4, 4 is merged into 5 and so is 7, which gives
    a chain 3→4→5 and a merge; 8 is abolished without a successor, and 6 is
    transferred to it before. Every other code is unchanged.
    """
    key = F.col("s_suppkey")
    return (
        _table(spark, sf_dir, "supplier")
        .filter((key % 10).isin(3, 4, 6, 7, 8))
        .select(
            key.cast("string").alias("old_cd"),
            F.when(key % 10 == 7, key - 2)
            .when(key % 10 == 6, key + 2)
            .when(key % 10 != 8, key + 1)
            .cast("string")
            .alias("new_cd"),
            F.when((key % 10).isin(3, 6), "transferred")
            .when(key % 10 == 8, "abolished")
            .otherwise("merged")
            .alias("change_type"),
            F.when(key % 10 == 4, "19970901")
            .when(key % 10 == 8, "19970801")
            .otherwise("19970701")
            .alias("effective_ymd"),
        )
    )


#: By last digit of a supplier key: day, digit of the new code (None: abolished), share.
CODE_CHANGES = (
    (3, "19970701", 4, 1.0),
    (4, "19970901", 5, 0.25),
    (4, "19970901", 6, 0.75),
    (6, "19960101", 8, 1.0),
    (6, "19980601", 7, 1.0),
    (7, "19970701", 5, 1.0),
    (8, "19970801", None, 1.0),
    (8, "19990101", 9, 1.0),
)


def dated_code_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented changes over supplier keys with a split and codes that are used again.

    3 is transferred to 4; 4 is split over 5 and 6; 6 goes to 8 and, used again, to 7; 7
    is merged into 5; 8 is abolished and, used again, transferred to 9.
    """
    changes = spark.createDataFrame(
        list(CODE_CHANGES), "digit int, effective_ymd string, new_digit int, share double"
    )
    key = F.col("s_suppkey")
    suppliers = _table(spark, sf_dir, "supplier").select(key, (key % 10).cast("int").alias("digit"))
    return suppliers.join(F.broadcast(changes), "digit").select(
        key.cast("string").alias("old_cd"),
        (key - F.col("digit") + F.col("new_digit")).cast("string").alias("new_cd"),
        "effective_ymd",
        "share",
    )
