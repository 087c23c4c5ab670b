"""Ranked search against scoring every document; the reading rule of the lists."""

import math
import random

import numpy as np
import pytest

from moveatlas.llm import lexical_search as L


def terms_by_letter(text):
    found, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                found.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return found


def brute_scores(docs, text, all_docs):
    """(score, position of the document) of every document for one item's text."""
    held = [terms_by_letter(t) for t in all_docs]
    n_docs = sum(bool(h) for h in held)
    n_terms = sum(map(len, held))
    result = []
    for i, words in enumerate(held):
        score = 0
        for term in terms_by_letter(text):
            tf = words.count(term)
            if tf:
                df = sum(term in h for h in held)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                m = 75 + (25 * len(words) * n_docs) // n_terms
                score += weight * ((10**9 * tf) // (1000 * tf + 12 * m))
        if score > 0:
            result.append((score, i))
    return result


def brute(rows, items, k):
    texts = [t for _, t in rows]
    result = []
    for item, text in items:
        scored = [(-s, rows[i][0] is None, rows[i][0] or 0) for s, i in brute_scores(rows, text, texts)]
        for rank, (s, null, key) in enumerate(sorted(scored)[:k], 1):
            result.append((item, rank, None if null else key, -s))
    return sorted(result, key=str)


def sample(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "ß2", "Ab", "aB", "x-y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 40))) for _ in range(n)]
    return rng, words, texts


def test_ranks_equal_scoring_of_every_document(spark):
    rng, words, texts = sample(1, 300)
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, " .,;"), (None, texts[3]), (None, texts[3])]
    rows += [(7, texts[8]), (7, texts[8]), (2**60 + 1, texts[9]), (2000, " ".join(texts))]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(8)]
    items += [(20, None), (21, ""), (22, "nowhere else"), (None, "w1 w2"), (0, "w3 w3 w3 w4"), (23, "W1, w1; w1")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, item string, rank int")
    asked = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, score int")
    found = L.rank_documents(docs.repartition(4), asked, k=5)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, items, 5)


def test_blocks_of_items_and_small_shards_change_nothing(spark, monkeypatch):
    rng, words, texts = sample(2, 200)
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(6)]
    monkeypatch.setattr(L, "BLOCK_TERMS", 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = L.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert len(list(L.read_items(iter(items)))) > 1
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(list(enumerate(texts)), items, 4)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.rank_documents(docs.limit(0), items).collect() == []
    assert L.rank_documents(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_shards_with_a_floor_keep_the_best(seed):
    """Against all scores, with ties, in shards read one after the other."""
    rng = np.random.default_rng(seed)
    n_terms, n_docs, k = 12, 400, 7
    table = rng.integers(0, 4, (n_terms, n_docs)) * rng.integers(0, 2, (n_terms, n_docs))
    times = rng.integers(1, 3, n_terms)
    want = sorted((-s, d) for d, s in enumerate((times @ table).tolist()) if s)[:k]
    best = L.Best(k)
    for at in range(0, n_docs, 100):
        part = table[:, at : at + 100]
        term, doc = np.nonzero(part)
        shard = L.Shard(doc, term, part[term, doc], 100, n_terms)
        found, scores = shard.search(np.arange(n_terms), times, k, best.floor)
        best.add(scores.tolist(), (found + at).tolist())
    assert [(s, key) for s, _, key in best.rows] == want


def test_reading_stops_before_the_lists_end(monkeypatch):
    """One document leads every list: few of the 5,000 documents are met."""
    monkeypatch.setattr(L, "FIRST_STEP", 2)
    n = 5000
    rng = np.random.default_rng(0)
    value = np.concatenate([rng.permutation(n - 3) // 50 + 1 for _ in range(3)])
    doc = np.concatenate([np.arange(3, n)] * 3 + [np.arange(3)] * 3)
    term = np.concatenate([np.repeat(np.arange(3), n - 3), np.repeat(np.arange(3), 3)])
    shard = L.Shard(doc, term, np.concatenate([value, np.full(9, 1000)]), n, 3)
    met = []
    inner = np.ix_
    monkeypatch.setattr(L.np, "ix_", lambda a, b: met.append(len(b)) or inner(a, b))
    found, scores = shard.search(np.arange(3), np.ones(3, np.int64), 3, 0)
    assert sorted(found) == [0, 1, 2] and set(scores) == {3000}
    assert sum(met) < 50
