"""The labelled sample, and what is learned from the labelled documents of the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moveatlas.llm import quality_rules


def test_one_row_per_labelled_id(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{body} copy {i % 3}") for i in range(500)] + [(i, f"{body} x " + "y" * i) for i in range(2, 7)]
    docs = spark.createDataFrame([*rows, (7, "too short")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, quality int")
    x, bad = quality_rules.labelled_stats(docs, labels, max_labelled=7)
    assert len(bad) == 6 and all(len(v) == 6 for v in x.values()) and sum(bad) == 3


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_tables_teach_a_list(spark, sf):
    """Every bad labelled document goes, no good one does but by the base rule."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit_rules(docs, labels)
    assert rules
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    found = quality_rules.judge(docs.join(known, "doc_id"), rules).where("NOT base_failed")
    got = {(r.quality, r.kept): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert got[0, False] > 0 and (0, True) not in got and (1, False) not in got


def test_half_the_labels_judge_the_other_half(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    even = F.xxhash64("doc_id") % 2 == 0
    rules = quality_rules.fit_rules(docs, labels.where(even))
    found = quality_rules.judge(docs.join(labels.where(~even), "doc_id"), rules).where("NOT base_failed").toPandas()
    rejected, bad = ~found["kept"], found["quality"] == 0
    assert (rejected & bad).sum() >= 0.9 * bad.sum() and (rejected & ~bad).sum() <= 0.01 * (~bad).sum()


def noise(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng, {k: rng.random(n) for k in quality_rules.FEATURES}


def test_a_useless_first_condition_is_pruned():
    _, x = noise(300)
    bad = x["symbols_per_word"] > 0.8
    rule = (quality_rules.Condition("n_words", True, 0.1), quality_rules.Condition("symbols_per_word", True, 0.8))
    assert quality_rules._prune(rule, x, bad) == rule[1:]


def test_a_rejected_rule_does_not_end_the_list(monkeypatch):
    """The first rule grown is refused; the next one is still found."""
    _, x = noise(600)
    bad = x["symbols_per_word"] > 0.9
    grown = [(quality_rules.Condition("upper_share", True, 0.5),)]
    inner = quality_rules._grow
    monkeypatch.setattr(quality_rules, "_grow", lambda x, bad: grown.pop() if grown else inner(x, bad))
    rules = quality_rules.learn_list(x, bad)
    assert any(c.feature == "symbols_per_word" for rule in rules for c in rule)


def test_labels_without_pattern_teach_nothing():
    rng, x = noise(400, 3)
    assert quality_rules.learn_list(x, rng.random(400) < 0.1) == []
