"""Catalog queries that write data: what is derived by joins is derived once and stays narrow."""

from pathlib import Path

from conftest import planned

from moveatlas.catalog import io_queries as Q
from moveatlas.plans import flows
from moveatlas.sources import sales_view


def test_parts_are_cut_from_stored_moves(spark, small):
    stored = Q._stored_moves(spark, small)
    assert "Join" not in planned(stored)
    assert stored.count() == spark.read.parquet(f"{small}/lineitem.parquet").count()


def test_batches_of_the_kept_mart_repeat_no_join(spark, small, monkeypatch):
    plans, write = [], Q.kept_mart.write_batch

    def spy(counts, *rest):
        plans.append(planned(counts))
        return write(counts, *rest)

    monkeypatch.setattr(Q.kept_mart, "write_batch", spy)
    assert Q.kept_indicator_mart(spark, small).count() > 0
    assert len(plans) >= 3 and not any("Join" in plan for plan in plans)


def test_csv_files_are_compressed_and_whole(spark, small):
    path = Q._as_csv(spark, small)
    files = [p.name for p in Path(path).glob("part-*")]
    assert files and all(name.endswith(".csv.snappy") for name in files)
    assert Q.C.read_counts_csv(spark, path).count() == spark.read.parquet(f"{small}/lineitem.parquet").count()


def test_days_are_made_text_below_the_joins(spark, small):
    for view in (sales_view.moves, sales_view.purpose_counts):
        plan = planned(view(spark, small))
        # Printed from the top: the join of line items and orders is the last one.
        assert plan.rindex("Join ") < plan.index("date_format")


def test_extracts_sum_pairs_before_the_two_sides(spark, small):
    plan = planned(flows.all_place_extracts(sales_view.moves(spark, small), 3))
    assert plan.index("Generate") < plan.index("HashAggregate")
