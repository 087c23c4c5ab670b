"""Lists that very many fingerprints share, hot groups, and ids beside null ids."""

import random

from test_operators import print_brute

import corpus_pipeline
from moveatlas.llm import simhash
from moveatlas.llm.components import components


def kept_brute(rows):
    """Keys, (is null, key or 0), of the rows (key, text) that the near-duplicate stage keeps."""
    prints = sorted({print_brute(t) for _, t in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= simhash.MAX_BITS:
                root[max(find(p), find(q))] = min(find(p), find(q))
    groups = {}
    for k, t in rows:
        groups.setdefault(find(print_brute(t)), []).append((k is None, k or 0))
    return sorted(min(g) for g in groups.values())


def test_stage_keeps_one_of_every_group(spark):
    """Exact copies, case and space changes, near copies, null and shared keys, clashing columns."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefé", k=5)) for _ in range(2000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(50, 250))) for _ in range(30)]
    for base in texts[:20]:
        for changed in (0, 1, 1, 2, 4):
            found = base.split()
            for at in rng.sample(range(len(found)), changed):
                found[at] = rng.choice(vocabulary)
            texts.append("  ".join(found).upper())
    texts += ["", " \n", None, "one two", "One  two", "one two three", "long " * 60000]
    rows = list(enumerate(texts)) + [(None, texts[5]), (None, "no key"), (None, "no key"), (7, "alone"), (7, "other"), (7, "other")]
    docs = spark.createDataFrame([(*r, "u", 1) for r in rows], "doc_id long, text string, root string, n int").repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == kept_brute(rows) and len(got) < len(rows) - 20
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_finer_masks_lose_no_pair():
    rng = random.Random(1)
    for fixed in (0, 0xFFFF, (1 << 40) - 1, (1 << 61) - 1):
        finer = simhash._masks(*simhash.FINER, fixed)
        free = [b for b in range(64) if not fixed >> b & 1]
        assert all(m & fixed == fixed for m in finer)
        for _ in range(200):
            x = sum(1 << b for b in rng.sample(free, min(len(free), rng.randint(0, 4))))
            assert any(x & m == 0 for m in finer)


def test_a_crowded_list_is_cut_and_keeps_its_links(spark):
    """6,000 fingerprints that agree in 32 bits, with close pairs planted among them."""
    rng = random.Random(5)
    top = 0x5A5A1234 << 32
    prints = {top | rng.getrandbits(32) for _ in range(6000)}
    planted = set()
    for p in sorted(prints)[::20]:
        planted.add((p, p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))))
    prints = sorted(prints | {q for _, q in planted})
    frame = spark.createDataFrame([(simhash._signed(p), 1) for p in prints], "fp long, n long")
    edges = simhash.near_pairs(frame, (5, 1))
    found = edges.selectExpr("bit_count(v ^ u) AS d").groupBy().max("d").first()[0]
    assert found <= simhash.MAX_BITS
    root = {r.v: r.u for r in components(edges).collect()}
    for p, q in planted:
        a, b = simhash._signed(p), simhash._signed(q)
        assert root.get(a, a) == root.get(b, b)


def test_hot_groups_and_large_ids_beside_null_ids(spark):
    big = 2**60 + 1
    rows = [(big + i, "the same words in every copy") for i in range(700)] + [(None, "the same words in every copy"), (None, "alone here")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, fingerprint int, root string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == sorted(
        [(big + i, big) for i in range(700)] + [(0, big), (0, 0)]
    )
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "alone here"), (big, "the same words in every copy")]
