"""Filters use stored columns only for their own source; lookups lose no people."""

import pytest
from conftest import count_row
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.functions.scalar import time_band
from moveatlas.operators import aggregates as A
from moveatlas.operators import filters as W
from moveatlas.operators.lookups import ABOLISHED, reconcile_admin_codes
from moveatlas.plans import flows
from moveatlas.sources import counts as C
from moveatlas.sources.counts import standardise_counts
from moveatlas.sources.sales_view import districts, moves
from moveatlas.streaming.ingest import ingest_new_files


@pytest.fixture
def ingested(counts):
    rows = counts({"ymd": "20240105", "hour": "03"}, {"ymd": "20240106", "hour": "04"})
    return standardise_counts(rows).withColumns({"effective_ymd": F.lit("20230916"), "fns": F.lit("20")})


def test_filters_on_a_second_column_keep_its_rows(ingested):
    assert W.date_range(ingested, "20230901", "20230930", column="effective_ymd").count() == 2
    assert W.date_range(ingested, "20240101", "20240131", column="effective_ymd").count() == 0
    assert W.months(ingested, 2023, [9], column="effective_ymd").count() == 2
    assert W.quarters(ingested, 2023, [3], column="effective_ymd").count() == 2
    assert W.hour_range(ingested, 18, 23, column="fns").count() == 2
    assert W.iso_weekdays(ingested, {6}, column="effective_ymd").count() == 2
    assert W.iso_weekdays(ingested, {5}).count() == 1
    assert W.hour_range(ingested, 3, 3).count() == 1


def test_a_column_that_is_nowhere_is_an_error(ingested):
    with pytest.raises(ValueError, match="nowhere"):
        W.hour_range(ingested, 1, 2, column="nowhere")
    with pytest.raises(ValueError, match="nowhere"):
        W.iso_weekdays(ingested, {1}, column="nowhere")


def test_lenient_ingest_takes_a_date_that_is_no_number(counts):
    row = standardise_counts(counts({"ymd": "unknown"}), strict=False).first()
    assert row[S.DATE_COL] is None and row[S.MONTH_COL] is None


def test_district_totals_add_up_to_all_visitors(spark, small):
    frame = moves(spark, small)
    ranked = flows.district_ranking(frame, districts(spark, small))
    assert ranked.agg(F.sum("visitors")).first()[0] == frame.agg(F.sum("total_cnt")).first()[0]
    assert ranked.where("district IS NULL").count() == 1
    twice = districts(spark, small).unionByName(districts(spark, small))
    with pytest.raises(ValueError):
        flows.district_ranking(frame, twice)


def test_flow_counts_people_and_not_bands(spark, small):
    frame = moves(spark, small).withColumn("total_cnt", F.lit(10.0))
    place = frame.first()["o_admdong_cd"]
    got = flows.place_extract(frame, place, "origin", 10_000)
    assert got.agg(F.sum("flow")).first()[0] == 10.0 * frame.where(F.col("o_admdong_cd") == place).count()


def test_abolished_codes_stay_visible(spark):
    history = spark.createDataFrame(
        [("a", None, "abolished", "20240101"), ("b", "a", "transferred", "20230101"), ("c", "d", "abolished", "20240101")],
        "old_cd string, new_cd string, change_type string, effective_ymd string",
    )
    frame = spark.createDataFrame([("a", "b", 1.0), ("c", "x", 2.0)], "o_admdong_cd string, d_admdong_cd string, total_cnt double")
    got = {tuple(r) for r in reconcile_admin_codes(frame, history).collect()}
    assert got == {(ABOLISHED, ABOLISHED, 1.0), (ABOLISHED, "x", 2.0)}


def test_stream_rejects_a_header_in_another_order(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    names = [*S.COUNTS_COLUMNS[:-2], S.COUNTS_COLUMNS[-1], S.COUNTS_COLUMNS[-2]]
    (src / "a.csv").write_text(",".join(names) + "\n" + ",".join(count_row()) + "\n")
    stream = ingest_new_files(spark, str(src), str(tmp_path / "dst"), str(tmp_path / "progress"))
    with pytest.raises(Exception, match="(?i)header"):
        stream.awaitTermination(60)
        raise stream.exception() or AssertionError("no error")


def test_batch_append_into_a_streamed_folder_is_read(spark, counts, tmp_path):
    src, dst, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    counts({"ymd": "20240105"}).coalesce(1).write.option("header", True).csv(src)
    ingest_new_files(spark, src, dst, progress).awaitTermination()
    C.write_by_month(C.standardise_counts(counts({"ymd": "20240106"})), dst, "append")
    assert C.scan_counts(spark, dst).count() == 2


def test_a_repeated_batch_does_not_double_its_rows(spark, counts, tmp_path):
    src, dst, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    counts({"ymd": "20240105"}).coalesce(1).write.option("header", True).csv(src)
    ingest_new_files(spark, src, dst, progress).awaitTermination()
    (tmp_path / "progress" / "commits" / "0").unlink()
    (tmp_path / "progress" / "commits" / ".0.crc").unlink(missing_ok=True)
    ingest_new_files(spark, src, dst, progress).awaitTermination()
    assert C.scan_counts(spark, dst).count() == 1


def test_first_band_of_an_hour_counts_and_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "hours")
    frame = spark.range(26).select(F.when(F.col("id") < 24, F.col("id")).cast("tinyint").alias("st_time_cd"))
    frame.write.parquet(path)
    bands = {"a": [(20, 23), (0, 3)], "b": [(2, 6), (22, 23)], "c": [(5, 30)]}
    stored = spark.read.parquet(path)
    for name in (*bands, "none"):
        got = W.in_time_bands(stored, bands, [name])
        want = stored.filter(time_band("st_time_cd", bands) == name)
        assert sorted(got.collect()) == sorted(want.collect())
    plan = W.in_time_bands(stored, bands, ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(st_time_cd,4)" in plan


def test_quantiles_window_only_over_wanted_partitions(spark):
    stats = A.summary_stats(spark.range(1000).select(F.col("id").cast("double").alias("v")), "v")
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    top = plan.index("Window [sum(copies")
    assert "Join Inner" in plan[top:] and "start" in plan[top:]
    assert tuple(stats.first()) == (499.5, 499.5, 0.0, 999.0, 250.0, 749.0)
    empty = A.summary_stats(spark.createDataFrame([], "v double"), "v")
    assert tuple(empty.first()) == (None,) * 6
