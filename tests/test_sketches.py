"""Rank errors of sketches, certain outliers, and samples that do not depend on partitions."""

import random
from bisect import bisect_left, bisect_right

import pytest

from moveatlas.operators import sketches as K


def frame(spark, n=20_000, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice("aaab"), rng.lognormvariate(0, 1) if i % 3 else float(i % 7)) for i in range(n)]
    return rows, spark.createDataFrame([*rows, ("a", None), ("n", None), ("a", float("nan"))], "g string, v double").repartition(7)


def off(values, got, q):
    lo, hi = bisect_left(values, got) / len(values), bisect_right(values, got) / len(values)
    return max(0.0, lo - q, q - hi)


@pytest.mark.parametrize("k", [50, 400])
def test_rank_errors_of_groups_and_of_merged_groups(spark, k):
    rows, df = frame(spark)
    names = {f"p{int(100 * q)}": q for q in (0.05, 0.25, 0.5, 0.75, 0.99)}
    by_group = K.quantile_sketches(df, "v", ["g"], k)
    found = {r.g: r for r in K.sketch_quantiles(by_group, names).collect()}
    assert set(found) == {"a", "b"}
    whole = K.sketch_quantiles(K.merge_sketches(by_group), names).first()
    assert whole["rows"] == len(rows)
    for values, row in [(sorted(v for g, v in rows if g == key), r) for key, r in found.items()] + [(sorted(v for _, v in rows), whole)]:
        assert all(off(values, row[name], q) <= K.rank_error(k, 2) for name, q in names.items())


def test_exact_outliers_lie_between_certain_and_possible(spark):
    rows, df = frame(spark)
    for r in K.sketched_outliers(df, "v", ["g"], times=2).collect():
        values = sorted(v for g, v in rows if g == r.g)
        q1, q3 = (values[round((len(values) - 1) * q)] for q in (0.25, 0.75))
        exact = sum(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) for v in values)
        assert r["rows"] == len(values) and r.certain <= exact <= r.possible
        assert 0 < r.certain and r.possible < len(values) / 3


def test_empty_frames(spark):
    _, df = frame(spark, 5)
    assert K.quantile_sketches(df.limit(0), "v").collect() == []
    assert K.sketched_outliers(df.limit(0), "v", ["g"]).collect() == []


def points(spark, parts, rows):
    return spark.createDataFrame(rows, "g string, x int, y int").repartition(parts)


def test_samples_depend_on_content_only(spark):
    rows = [("ab"[i % 2], i % 50, i // 50) for i in range(400)] + [(None, 1, 1), ("c", None, 1)]
    one = sorted(map(str, K.hash_sample(points(spark, 1, rows), "g", ["x", "y"], 5).collect()))
    many = sorted(map(str, K.hash_sample(points(spark, 9, rows + rows), "g", ["x", "y"], 5).collect()))
    assert one == many and len(one) == 12
    other = sorted(map(str, K.hash_sample(points(spark, 1, rows), "g", ["x", "y"], 5, seed=1).collect()))
    assert one != other


def test_samples_merge(spark):
    rows = [("a", i, 0) for i in range(100)]
    halves = [K.hash_sample(points(spark, 2, rows[i::2]), "g", ["x", "y"], 6) for i in (0, 1)]
    merged = K.hash_sample(halves[0].unionByName(halves[1]), "g", ["x", "y"], 6)
    whole = K.hash_sample(points(spark, 3, rows), "g", ["x", "y"], 6)
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))
