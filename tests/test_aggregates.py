import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from moveatlas.operators import aggregates as A


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(4)


def nearest(values, q):
    ordered = sorted(values)
    return ordered[math.floor((len(ordered) - 1) * q + 0.5)]


@pytest.mark.parametrize("n", range(1, 9))
def test_nearest_quartiles_and_median(spark, n):
    values = [float(3 * i % 11) for i in range(n)]
    got = A.summary_stats(numbers(spark, values), "v").first()
    assert got["mean"] == pytest.approx(statistics.mean(values))
    assert got["median"] == statistics.median(values)
    assert (got["min"], got["max"]) == (min(values), max(values))
    assert (got["q1"], got["q3"]) == (nearest(values, 0.25), nearest(values, 0.75))


def test_quantile_of_four_values_is_not_interpolated(spark):
    df = numbers(spark, [1.0, 2.0, 3.0, 4.0])
    assert A.exact_quantiles(df, "v", {"q": 0.25}).first().q == 2.0
    assert A.exact_quantiles(df, "v", {"q": 0.25}, method="linear").first().q == 1.75
    with pytest.raises(ValueError):
        A.exact_quantiles(df, "v", {"q": 0.25}, method="midpoint")


def test_quantiles_over_many_partitions_with_one_hot_value(spark, many_partitions):
    random.seed(5)
    values = [7.0] * 400 + [float(random.randrange(1000)) for _ in range(800)] + [None] * 50
    known = [v for v in values if v is not None]
    got = A.exact_quantiles(numbers(spark, values), "v", {"a": 0.1, "b": 0.5, "c": 0.9, "d": 1.0, "e": 0.0})
    assert got.first().asDict() == {
        name: nearest(known, q)
        for name, q in {"a": 0.1, "b": 0.5, "c": 0.9, "d": 1.0, "e": 0.0}.items()
    }
    linear = A.exact_quantiles(numbers(spark, values), "v", {"m": 0.5}, method="linear").first().m
    assert linear == statistics.median(known)


def test_stats_of_no_values_are_null(spark):
    assert set(A.summary_stats(numbers(spark, [None]), "v").first()) == {None}


def test_group_totals_of_null_groups_and_means(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 2.0), (None, 5.0)], "k string, v double")
    totals = {r.k: r.t for r in A.group_totals(df, "k", {"t": "v"}).collect()}
    means = {r.k: r.m for r in A.group_means(df, "k", {"m": "v"}).collect()}
    assert totals == {"a": 0.0, "b": 3.0, None: 5.0}
    assert means == {"a": None, "b": 1.5, None: 5.0}


def test_top_k_stats_look_at_the_k_best_groups(spark):
    df = spark.createDataFrame([(f"k{i:02d}", float(i)) for i in range(50)], "k string, v double")
    got = A.top_k_stats(df, "v", "k", 30).first()
    assert got["mean"] == statistics.mean(range(20, 50))
    assert got["median"] == statistics.median(range(20, 50))


def test_smallest_positive_and_zero_count(spark):
    df = numbers(spark, [0.0, 0.0, 3.0, 2.0, None, -1.0])
    assert A.min_positive(df, "v").first().min_positive == 2.0
    assert A.count_zero(df, "v").first().zero_count == 2
    assert A.min_positive(numbers(spark, [0.0]), "v").first().min_positive is None


def test_monthly_means_and_trend(spark):
    rows = [("a", 202311, 1.0), ("a", 202312, 1.0), ("a", 202312, 1.0), ("a", 202401, 3.0), ("b", 202401, 4.0)]
    df = spark.createDataFrame(rows, "k string, m int, x double")
    got = {r.k: r.asDict() for r in A.monthly_means(df, "k", F.col("m"), ["x"]).collect()}
    assert got["a"] == {"k": "a", "months": 3, "mean_x": 2.0, "trend_x": pytest.approx(1.0)}
    assert got["b"]["mean_x"] == 4.0 and got["b"]["trend_x"] is None


def test_band_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 1.0, 3.0), ("b", 0.0, 0.0)], "k string, x double, y double")
    got = {r.k: r.asDict() for r in A.band_mix(df, "k", ["x", "y"]).collect()}
    assert got["a"]["total_x"] == 2.0 and got["a"]["share_y"] == pytest.approx(0.75)
    assert got["b"]["share_x"] == 0.0
