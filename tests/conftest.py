import sys
from contextlib import contextmanager
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import pytest

from moveatlas import schema as S
from moveatlas.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "moveatlas-tests", 8, **{"spark.sql.maxMetadataStringLength": "100000", "spark.sql.debug.maxToStringFields": "1000"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def many_partitions(spark):
    """Keep shuffle partitions apart, so that small frames span several of them."""
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        yield


@contextmanager
def setting(spark, key, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def count_row(
    ymd="20240105", hour="18", purpose=S.SHOPPING, place="A_B_C", cells="1", total="16", **other
):
    """One row of purpose counts as text; ``cells`` fills all sixteen counts."""
    province, district, _ = place.split("_")
    row = {
        "ETL_YMD": ymd,
        "TIME_CD": hour,
        "MOVE_PURPOSE": purpose,
        S.PROVINCE: province,
        S.DISTRICT: district,
        S.PLACE: place,
        **{c: cells for c in S.COUNT_COLS},
        "TOTAL_CNT": total,
    }
    return tuple({**row, **other}[name] for name in S.COUNTS_COLUMNS)


@pytest.fixture
def counts(spark):
    def make(*rows):
        return spark.createDataFrame([count_row(**r) for r in rows], S.COUNTS_TEXT_SCHEMA)

    return make


def executed_plan(df) -> str:
    """The final plan, after running it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
