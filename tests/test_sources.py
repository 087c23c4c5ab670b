import pytest
from conftest import setting
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.operators import filters as W
from moveatlas.plans import flows
from moveatlas.session import scratch_path, shared_folder
from moveatlas.sources import counts as C
from moveatlas.sources import moves as M
from moveatlas.streaming.ingest import ingest_new_files


def write_csv(df, path):
    df.write.option("header", True).csv(path)
    return path


def test_csv_keeps_text(spark, counts, tmp_path):
    src = write_csv(counts({"hour": "08", "cells": "1.50"}), str(tmp_path / "in"))
    row = C.read_counts_csv(spark, src).first()
    assert (row.TIME_CD, row.MALE_00_CNT) == ("08", "1.50")


def test_csv_with_another_header_is_an_error(spark, tmp_path):
    frame = spark.createDataFrame([tuple("x" for _ in S.COUNTS_COLUMNS)], [f"c{i}" for i in range(len(S.COUNTS_COLUMNS))])
    src = write_csv(frame, str(tmp_path / "in"))
    with pytest.raises((PySparkException, Py4JJavaError), match="header does not conform"):
        C.read_counts_csv(spark, src).collect()


def test_ingest_writes_typed_months(spark, counts, tmp_path):
    days = ["20240131", "20240201", "20240229", "20241231"]
    src = write_csv(counts(*({"ymd": d, "hour": "07"} for d in days)), str(tmp_path / "in"))
    dst = str(tmp_path / "out")
    stored = C.ingest_csv_to_parquet(spark, src, dst)
    kinds = dict(stored.dtypes)
    assert (kinds["HOUR"], kinds["ETL_DATE"], kinds["MALE_00_CNT"], kinds["ETL_YM"]) == ("int", "date", "double", "int")
    assert sorted(p.name for p in (tmp_path / "out").glob("ETL_YM=*")) == ["ETL_YM=202401", "ETL_YM=202402", "ETL_YM=202412"]
    assert sorted(r.ETL_YMD for r in stored.collect()) == days


@pytest.mark.parametrize("row", [{"ymd": "20240132"}, {"cells": "*"}, {"hour": "8.0"}])
def test_bad_input_fails_or_becomes_null(spark, counts, tmp_path, row):
    src = write_csv(counts(row, {"ymd": "20240105"}), str(tmp_path / "in"))
    with pytest.raises(PySparkException):
        C.ingest_csv_to_parquet(spark, src, str(tmp_path / "strict"))
    kept = C.ingest_csv_to_parquet(spark, src, str(tmp_path / "lenient"), strict=False)
    assert kept.count() == 2


def test_one_hot_month_is_split_over_files(spark, counts, tmp_path):
    rows = counts(*({"ymd": f"202401{i % 28 + 1:02d}", "total": str(i)} for i in range(4000))).repartition(8)
    typed = C.standardise_counts(rows.union(counts({"ymd": "20240205"})))
    with setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "4KB"):
        C.write_by_month(typed, str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "ETL_YM=202401").glob("*.parquet"))) > 2
    assert C.scan_counts(spark, str(tmp_path / "out")).count() == 4001


def test_new_files_are_ingested_once(spark, counts, tmp_path):
    src, dst, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run():
        ingest_new_files(spark, src, dst, progress, files_per_batch=1).awaitTermination()
        return C.scan_counts(spark, dst).count()

    counts({"ymd": "20240105"}).coalesce(1).write.option("header", True).csv(src)
    assert run() == 1
    assert run() == 1
    counts({"ymd": "20240206"}, {"ymd": "20240207"}).coalesce(1).write.mode("append").option("header", True).csv(src)
    assert run() == 3


def test_scan_of_a_plain_tree(spark, counts, tmp_path):
    counts({"ymd": "20240105"}).write.parquet(str(tmp_path / "a" / "b"))
    counts({"ymd": "20240106"}).write.parquet(str(tmp_path / "c"))
    assert C.scan_counts(spark, str(tmp_path), recursive=True).count() == 2


def moves(spark, *rows):
    return spark.createDataFrame([(*r, "1", "2", 1.0, 2.0, "1", 1.0, 1.0, 1.0, 1.0, 4.0) for r in rows], S.MOVES_SCHEMA)


def test_merge_fills_missing_columns_and_updates_codes(spark, tmp_path):
    a = moves(spark, ("A", "Z", "20240105"))
    b = moves(spark, ("Z", "A", "20240206")).drop("move_time")
    history = spark.createDataFrame([("A", "B")], "old_cd string, new_cd string")
    got = M.merge_moves([a, b], history, str(tmp_path / "m"))
    assert {(r.o_admdong_cd, r.d_admdong_cd, r.move_time, r.etl_ym) for r in got.collect()} == {
        ("B", "Z", 2.0, 202401), ("Z", "B", None, 202402),
    }


def test_optimised_copy_holds_the_same_rows(spark, tmp_path):
    df = moves(spark, ("A", "Z", "20240105"), ("B", "Z", "20240205"))
    got = M.optimise_layout(df, str(tmp_path / "o"))
    assert dict(got.dtypes)["st_time_cd"] == "tinyint"
    assert got.agg(F.sum("total_cnt"), F.count("etl_date")).first()[:] == (8.0, 2)


def test_flows_read_the_optimised_copy(spark, tmp_path):
    df = moves(spark, ("A", "Z", "20240105"), ("Z", "A", "20240105"), ("A", "Z", "20240205"), ("A", "Z", "20240305"))
    small = M.optimise_layout(df, str(tmp_path / "o"))
    assert "etl_ymd" not in small.columns
    for plan in (flows.hotplace_index, flows.bedtown_index, flows.place_profile, flows.monthly_trend):
        assert sorted(map(tuple, plan(small).collect())) == sorted(map(tuple, plan(df).collect()))
    spring = W.date_range(small, "20240105", "20240229", column="etl_ymd")
    assert spring.count() == 3
    read = spring._jdf.queryExecution().executedPlan().toString()
    assert "etl_ym" in read.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(etl_date" in read
    assert W.months(small, 2024, [2, 3], column="etl_ymd").count() == 2


def test_codes_in_moves_csv_keep_leading_zeros(spark, tmp_path):
    src = write_csv(moves(spark, ("0011", "0020", "20240105")), str(tmp_path / "in"))
    assert M.read_moves_csv(spark, src).first().o_admdong_cd == "0011"


def test_export_and_extract(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    C.export_csv(df, str(tmp_path / "csv"))
    lines = [f.read_text().splitlines() for f in (tmp_path / "csv").glob("*.csv")]
    assert all(text[0] == "k,v" for text in lines)
    assert [line for text in lines for line in text[1:]] == ["a,1.0"]
    C.write_extract(df, str(tmp_path / "extract"))
    assert C.load_columns(spark, [str(tmp_path / "extract")], ["v"]).columns == ["v"]


def test_scratch_paths_are_new_and_below_the_shared_folder(spark):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(shared_folder(spark))
