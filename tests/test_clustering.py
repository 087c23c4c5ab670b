"""The copy clustered on two codes: all rows, few row groups for either side."""

import random

import pyarrow.parquet as pq
import pytest
from conftest import setting
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.plans import flows
from moveatlas.sources import clustering as Z
from moveatlas.sources import counts as C
from moveatlas.sources import moves as M

COLUMNS = "o_admdong_cd string, d_admdong_cd string, etl_ymd string, st_time_cd string, fns_time_cd string, total_cnt double, " + ", ".join(f"`{b}` double" for b in S.BAND_COLS)


def move_rows(n, places=50, seed=1):
    rng = random.Random(seed)
    codes = [f"{11000 + 7 * i}" for i in range(places)]
    return [
        (rng.choice(codes), rng.choice(codes), f"2024{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}", f"{rng.randint(0, 23):02d}", "23", float(i % 9), 1.0, 2.0, 3.0, 4.0)
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def moves(spark):
    return spark.createDataFrame(move_rows(40_000), COLUMNS).repartition(4)


def groups(path, column, value):
    """Row groups whose range of a column holds the value, and all of them."""
    hit = whole = 0
    for file in path.rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == column)
        for i in range(meta.num_row_groups):
            stats = meta.row_group(i).column(at).statistics
            whole += 1
            hit += stats.min <= value <= stats.max
    return hit, whole


@pytest.mark.parametrize("column", ["o_admdong_cd", "d_admdong_cd"])
def test_extracts_of_both_sides_read_few_row_groups(spark, moves, tmp_path, column):
    code = "11070"
    stored = Z.write_clustered(moves, str(tmp_path / "z"), files=64)
    hit, whole = groups(tmp_path / "z", column, code)
    assert whole >= 60 and hit <= whole / 2
    Z.write_clustered(moves, str(tmp_path / "codes"), keys=Z.CODE_KEYS, files=64)
    hit, whole = groups(tmp_path / "codes", column, code)
    assert whole >= 60 and hit <= whole / 3
    want = moves.filter(F.col(column) == code).count()
    assert stored.filter(F.col(column) == code).count() == want
    if column == "o_admdong_cd":
        narrow = M.optimise_layout(moves, str(tmp_path / "one"))
        assert narrow.count() == stored.count() == moves.count()
        hit, whole = groups(tmp_path / "one", column, code)
        assert hit == whole


def test_all_rows_are_written_unchanged(spark, moves, tmp_path):
    stored = Z.write_clustered(moves, str(tmp_path / "z"))
    columns = moves.columns
    kept = M.standardise_moves(moves).select(*columns)
    assert stored.select(*columns).exceptAll(kept).isEmpty() and kept.exceptAll(stored.select(*columns)).isEmpty()


def test_bloom_filters_leave_out_absent_codes(spark, moves, tmp_path):
    """A code within every range that no row has: no row group is read."""
    stored = Z.write_clustered(moves, str(tmp_path / "z"))
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        wanted = spark.read.parquet(str(tmp_path / "z")).filter(F.col("o_admdong_cd") == "11071")
        assert wanted.collect() == []
        leaves = wanted._jdf.queryExecution().executedPlan().collectLeaves()
        assert leaves.head().metrics().get("numOutputRows").get().value() == 0
    assert stored.filter(F.col("o_admdong_cd") == "11070").count() > 0


def test_null_codes_and_one_hot_flow(spark, tmp_path):
    rows = move_rows(300) + [(None, "11000", "20240101", "01", "02", 1.0, 1.0, 1.0, 1.0, 1.0)] * 5
    rows += [("11000", "11007", "20240101", "01", "02", float(i), 1.0, 1.0, 1.0, 1.0) for i in range(600)]
    stored = Z.write_clustered(spark.createDataFrame(rows, COLUMNS), str(tmp_path / "z"), files=8)
    assert stored.count() == len(rows)
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 400


def test_an_empty_frame(spark, moves, tmp_path):
    assert Z.write_clustered(moves.limit(0), str(tmp_path / "z")).count() == 0


def test_ranges_and_interleaving(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("bb", 1), ("c", 2), ("z", 3), (None, 0)], "k string, n int")
    got = df.select(Z.range_number("k", ["b", "c", "d"]).alias("x"), "n").collect()
    assert all(r.x == r.n for r in got)
    value = spark.range(1).select(Z.interleaved([F.lit(0b101), F.lit(0b011)], 3)).first()[0]
    assert value == 0b100111


@pytest.mark.parametrize("side", ["origin", "destination"])
def test_all_extracts_equal_the_single_ones(spark, moves, tmp_path, side):
    whole = flows.all_place_extracts(moves, 5)
    C.write_all_extracts(whole, str(tmp_path / "x"))
    stored = spark.read.parquet(str(tmp_path / "x"))
    for place in ("11000", "11070", "11343"):
        want = flows.place_extract(moves, place, side, 5)
        got = flows.one_extract(stored, place, side)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_all_extracts_scan_once(spark, moves):
    plan = flows.all_place_extracts(moves, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
