import random

from conftest import setting

from moveatlas.operators import ranking as K

NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


def test_nulls_come_first_and_nan_is_largest(spark):
    df = frame(spark, [("a", 1.0), ("b", None), ("c", NAN), ("d", 2.0)])
    assert [r.k for r in K.sort_rows(df, "v", "k").collect()] == ["b", "c", "d", "a"]
    assert [r.k for r in K.sort_rows(df, "v", "k", ascending=True).collect()] == ["b", "a", "d", "c"]


def test_ties_are_broken_by_the_key(spark):
    df = frame(spark, [("b", 1.0), ("a", 1.0), ("c", 2.0)])
    got = K.top_ranked(df, "v", "k", 3).collect()
    assert [(r.RANK, r.k) for r in got] == [(1, "c"), (2, "a"), (3, "b")]


def test_limit_before_or_after_ranking_is_the_same(spark):
    rows = [(f"k{i:02d}", float(i % 7)) for i in range(40)]
    df = frame(spark, rows)
    first = {(r.RANK, r.k) for r in K.top_ranked(df, "v", "k", 9).collect()}
    second = {(r.RANK, r.k) for r in K.rank_rows(df, "v", "k").filter("RANK <= 9").collect()}
    assert first == second


def test_rank_of_all_rows_over_many_partitions(spark, many_partitions):
    random.seed(3)
    rows = [(f"k{i:04d}", random.choice([0.0, 0.0, None, NAN, random.random()])) for i in range(900)]
    got = {r.k: r.RANK for r in K.rank_rows(frame(spark, rows), "v", "k").collect()}

    def position(row):
        key, value = row
        if value is None:
            return (0, 0.0, key)
        return (1, 0.0, key) if value != value else (2, -value, key)

    assert got == {row[0]: i for i, row in enumerate(sorted(rows, key=position), 1)}


def test_rank_spreads_one_tied_score_over_partitions(spark, many_partitions):
    """A score shared by every row is split by the key, not sent to one task."""
    df = frame(spark, [(f"k{i:04d}", 1.0) for i in range(800)])
    ranked = K.rank_rows(df, "v", "k")
    assert ranked.rdd.getNumPartitions() > 1
    sizes = ranked.rdd.glom().map(len).collect()
    assert max(sizes) < 400 and sum(sizes) == 800


def test_rank_of_an_empty_frame(spark):
    assert K.rank_rows(frame(spark, []), "v", "k").count() == 0


def test_top_n_per_group(spark):
    rows = [("a", i % 3, f"k{i}", float(i)) for i in range(9)] + [("b", 0, "z", None)]
    df = spark.createDataFrame(rows, "g string, h int, k string, v double")
    got = {(r.g, r.k, r.RANK) for r in K.top_n_per_group(df, "g", "v", "k", 2).collect()}
    assert got == {("a", "k8", 1), ("a", "k7", 2), ("b", "z", 1)}


def test_preview(spark):
    assert len(K.preview(frame(spark, [("a", 1.0)] * 9), ["k"], 4).collect()) == 4


def test_large_n_is_cut_per_salt_before_the_group_meets(spark):
    rows = [("hot" if i % 3 else "cold", f"k{i:04d}", float(i % 50)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k string, v double")
    with setting(spark, "spark.sql.optimizer.windowGroupLimitThreshold", "5"):
        got = {(r.g, r.k, r.RANK) for r in K.top_n_per_group(df, "g", "v", "k", 60).collect()}
    expected = set()
    for group in ("hot", "cold"):
        ordered = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1]))
        expected |= {(group, r[1], i) for i, r in enumerate(ordered[:60], 1)}
    assert got == expected
