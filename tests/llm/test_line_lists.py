"""Sites with long lists of boilerplate lines, against brute force."""

import random
from collections import Counter

import pytest

from moveatlas.llm import line_dedup


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_long_lists_drop_the_same_lines(spark, bound):
    rng = random.Random(2)
    shared = {s: [f"{s or 'none'} menu line {i}" for i in range(k)] for s, k in (("a", 400), ("b", 9), (None, 40), ("c", 0))}
    rows = []
    for s, lines in shared.items():
        for page in range(40):
            own = [f"{s} {page} {i}" for i in range(5)] + rng.sample(lines, len(lines) // 2) + ["a menu line 1"] * (page == 0)
            rng.shuffle(own)
            rows.append((len(rows), "\n".join(own), s))
    rows += [(len(rows), None, "a"), (len(rows) + 1, "", "a"), (len(rows) + 2, "x\n" * 20000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, max_lines=bound).collect()}
    pages, holds = {}, {}
    for _, text, s in rows:
        if text is not None:
            pages.setdefault(s, set()).add(text)
    for s, texts in pages.items():
        holds[s] = Counter(line for t in texts for line in {x.strip(" \t\r") for x in t.split("\n")} if line)
    n_dropped = 0
    for key, text, s in rows:
        if text is None:
            assert got[key].text is None
            continue
        often = {x for x, n in holds[s].items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * len(pages[s])}
        kept = [x for x in text.split("\n") if x.strip(" \t\r") not in often]
        assert got[key].text == "\n".join(kept)
        n_dropped += len(text.split("\n")) - len(kept)
    assert n_dropped > 8000 and sum(r.n_dropped for r in got.values()) == n_dropped
