"""What must hold in the physical plans for the work to scale."""

import re

import pytest
from conftest import executed_plan, planned, setting
from pyspark.sql import functions as F

from moveatlas import schema as S
from moveatlas.catalog import all_queries
from moveatlas.operators.lookups import attach_lookup, reconcile_admin_codes
from moveatlas.operators.ranking import top_k
from moveatlas.plans import bedtown, flows, mart, visits
from moveatlas.sources import counts as C

YEAR = ("20240101", "20241231")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from conftest import count_row

    rows = [
        count_row(ymd=f"2024{m:02d}{d:02d}", place=f"A_{'XY'[d % 2]}_{d % 7}", hour=f"{(d * 5) % 24:02d}")
        for m in (1, 2, 3) for d in range(1, 29)
    ]
    root = tmp_path_factory.mktemp("stored")
    text = spark.createDataFrame(rows, S.COUNTS_TEXT_SCHEMA)
    text.write.parquet(str(root / "text"))
    C.write_by_month(C.standardise_counts(text), str(root / "typed"))
    return {name: C.scan_counts(spark, str(root / name)) for name in ("text", "typed")}


def test_period_and_purposes_reach_a_text_scan(stored):
    plan = planned(bedtown.return_ratio(stored["text"], YEAR))
    pushed = re.search(r"PushedFilters: \[([^]]*)", plan).group(1)
    assert "GreaterThanOrEqual(ETL_YMD" in pushed and "In(MOVE_PURPOSE" in pushed
    read = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert "TOTAL_CNT" not in read and "SIDO_NM" not in read


def test_months_prune_partitions_and_hours_reach_a_typed_scan(stored):
    plan = planned(bedtown.return_ratio(stored["typed"], ("20240201", "20240229")))
    assert re.search(r"PartitionFilters: \[[^]]*ETL_YM[^]]*>= 202402", plan)
    assert "GreaterThanOrEqual(HOUR,18)" in plan
    assert "cast(MALE_00_CNT" not in plan


def test_one_shuffle_and_no_single_task_before_the_top(stored):
    best = top_k(bedtown.return_ratio(stored["text"], YEAR), "RETURN_RATIO", S.PLACE, 30)
    plan = planned(best)
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in plan and "TakeOrderedAndProject" in plan
    assert "SinglePartition" not in plan


def test_mart_is_one_scan_and_one_shuffle(stored):
    plan = planned(mart.indicator_mart(stored["typed"], YEAR))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_filled_scores_reuse_the_aggregation(stored):
    plan = executed_plan(visits.fill_zero_scores(visits.ratio_scores(stored["typed"], YEAR)))
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


MOVES = "o_admdong_cd string, d_admdong_cd string, etl_ymd string, st_time_cd string, total_cnt double"


@pytest.fixture(scope="module")
def moves(spark, tmp_path_factory):
    rows = [(str(i % 3), str(i % 5), f"202401{i % 28 + 1:02d}", f"{i % 24:02d}", float(i)) for i in range(200)]
    path = str(tmp_path_factory.mktemp("moves") / "m")
    spark.createDataFrame(rows, MOVES).write.parquet(path)
    return spark.read.parquet(path)


def test_top_n_limits_groups_before_the_shuffle(moves):
    plan = planned(flows.top_destinations(moves, 2))
    assert plan.count("WindowGroupLimit") == 2


def test_indices_scan_the_moves_once(moves):
    assert planned(flows.place_profile(moves)).count("FileScan") == 1
    assert planned(flows.bedtown_index(moves)).count("Exchange") == 1
    compared = executed_plan(flows.compare_places(flows.place_profile(moves)))
    assert "ReusedExchange" in compared
    assert "CartesianProduct" not in compared and "NestedLoop" not in compared


def test_lookup_is_broadcast_only_below_its_limit(spark, moves):
    lookup = spark.createDataFrame([("0", "x")], "code string, label string")
    small = attach_lookup(moves, lookup, "code", "o_admdong_cd")
    assert "BroadcastHashJoin" in planned(small)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        large = attach_lookup(moves, lookup, "code", "o_admdong_cd", max_bytes=0)
        plan = planned(large)
    assert "Broadcast" not in plan and "__salt" in plan


def test_one_hot_key_spreads_over_salts(spark, many_partitions):
    facts = spark.range(4000).select(F.lit("hot").alias("code"), F.col("id").alias("n"))
    lookup = spark.createDataFrame([("hot", "x")], "code string, label string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        joined = attach_lookup(facts, lookup, "code", "code", max_bytes=0)
        sizes = joined.rdd.glom().map(len).collect()
        assert sum(sizes) == 4000 and max(sizes) < 2000
        assert joined.filter("label = 'x'").count() == 4000


def test_salted_joins_move_only_wanted_columns(spark, moves):
    history = spark.createDataFrame([("0", "1"), ("3", "4")], "old_cd string, new_cd string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        recoded = reconcile_admin_codes(moves, history, max_bytes=0)
        plan = planned(recoded.groupBy("o_admdong_cd", "d_admdong_cd").agg(F.sum("total_cnt")))
    # Below the first shuffle the salt is made from every column, above it only the salt is there.
    assert plan.count("xxhash64") == 1 and plan.count("SortMergeJoin") == 2
    assert recoded.columns == moves.columns


def test_rank_errors_of_all_rows_gather_no_row(spark, small):
    plan = planned(all_queries()["st07_sketch_rank_error"](spark, small))
    # Printed from the top: the row for all places is made above the joins, from counts of places.
    assert plan.index("explode(array(") < plan.index("Join")


@pytest.mark.parametrize("name", ["q02_hotness_top30", "q12_filled_scores_top30", "mart_all_indicators",
                                  "st05_transform_origin", "q27_bedtown_against_hotplace"])
def test_no_python_and_no_cross_join_in_the_plan(spark, small, name):
    plan = planned(all_queries()[name](spark, small))
    for word in ("Python", "ArrowEval", "CartesianProduct", "NestedLoop"):
        assert word not in plan


def test_orders_are_cut_at_the_scan(spark, small):
    plan = planned(all_queries()["q05_bedtown_place_top30"](spark, small))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(o_orderdate", plan)
    assert "l_extendedprice" not in plan
