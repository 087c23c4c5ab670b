"""Suffix dedup of shared lines that repeat a short text, between other surroundings."""

import random

from test_operators import suffix_brute

from moveatlas.llm import suffix_dedup


def test_periodic_lines_between_random_surroundings(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz "
    rows = []
    for _ in range(300):
        period = "".join(rng.choices(letters, k=rng.randint(1, 30)))
        line = (period * 64)[: rng.randint(50, 64)]
        for _ in range(2):
            sides = ["".join(rng.choices(letters, k=rng.randint(20, 120))) for _ in range(2)]
            rows.append((len(rows), line.join(sides)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.cut_repeats(docs).drop("kept")
    assert sorted(map(tuple, got.collect())) == sorted(suffix_brute(rows))


def test_large_buckets_are_sorted_by_spark(spark, monkeypatch):
    """One common 20-byte string between other surroundings; strings settled by Spark alike."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_STRINGS", 40)
    rng = random.Random(13)
    sides = ["".join(rng.choices("abcdefgh ", k=40)) for _ in range(12)]
    rows = [(i, rng.choice(sides) + "the common string 20" + rng.choice(sides) + str(rng.random())) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = suffix_dedup.cut_repeats(docs).drop("kept")
    assert sorted(map(tuple, got.collect())) == sorted(suffix_brute(rows))


def twice_by_search(raw):
    """Runs whose bucket string stands twice in the bytes that the run's strings cover."""
    bucket, first, last, *_, kind = suffix_dedup.runs(raw)
    width = suffix_dedup.LENGTH - suffix_dedup.GRAM + 1
    for i in range(len(first)):
        span = raw[first[i] : last[i] + suffix_dedup.LENGTH]
        grams = [span[j : j + suffix_dedup.GRAM] for j in range(len(span) - suffix_dedup.GRAM + 1)]
        repeated = any(grams.count(g) > 1 for g in set(grams) if g == own_gram(raw, first[i], last[i], width))
        assert (kind[i] == suffix_dedup.TWICE) == repeated


def own_gram(raw, first, last, width):
    import numpy as np

    by_16 = suffix_dedup.grams(np.frombuffer(raw, np.uint8), suffix_dedup.ODD[0])
    buckets = suffix_dedup.scattered(suffix_dedup.refine(by_16, suffix_dedup.GRAM - 16, suffix_dedup.ODD[0]))
    at = first + int(np.argmin(buckets[first : first + width]))
    return raw[at : at + suffix_dedup.GRAM]


def test_runs_that_hold_their_bucket_string_twice():
    rng = random.Random(17)
    for _ in range(60):
        parts = ["".join(rng.choices("ab", k=rng.randint(1, 30))) * rng.randint(1, 5) for _ in range(6)]
        twice_by_search("".join(parts).encode())
