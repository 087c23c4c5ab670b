"""Token alignment against byte-by-byte brute force; both ways of running tokenizer A."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from moveatlas.llm import token_alignment as T

PAIR = T.tokenizers_of(T.FILES)

TEXTS = [
    "The quick brown fox, the lazy dog; naïve café 12345 67.",
    "déjà vu — 東京 🙂 ﬁne　wide\xa0space",
    "<|endoftext|> <s> </s> <unk> <0x41> [INST]",
    "  two  spaces\n\n\tand tabs \r\n",
    "▁ U+2581 ▁▁ itself",
    "a",
    " ",
    "\n",
    "x" * 3000,
    " ".join(["long text"] * 4000),
    "The quick brown fox, the lazy dog; naïve café 12345 67.",
    "\x00\x01 control \x7f",
]


def tokens(text):
    """(id, bytes) of both tokenizers by their own libraries, or none."""
    if not text:
        return [], []
    whole = (" " + text).encode()
    letters = {}
    extra = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters[chr(b)] = b
        else:
            letters[chr(extra)] = b
            extra += 1
    a = [
        (i, bytes(letters[c] for c in PAIR.a.id_to_token(i)))
        for i in PAIR.a.encode(" " + text, add_special_tokens=False).ids
    ]
    b = []
    for i in PAIR.b.encode(text):
        piece = PAIR.b.id_to_piece(i)
        one = PAIR.b.is_byte(i)
        b.append((i, bytes([int(piece[1:-1], 16)]) if one else piece.replace("▁", " ").encode()))
    good = all(b"".join(p for _, p in found) == whole for found in (a, b))
    return (a, b) if good else ([], [])


def brute(texts):
    """Rows of counts, groups and links; every link by comparing all token ends."""
    docs = []
    for text in texts:
        a, b = tokens(text)
        ends = []
        for found in (a, b):
            at, own = 0, []
            for i, part in found:
                at += len(part)
                own.append((at, i))
            ends.append(own)
        links = [(i, j) for e, i in ends[0] for f, j in ends[1] if e == f] if len(a) < 3500 else None
        if links is None:
            of_b = dict(ends[1])
            links = [(i, of_b[e]) for e, i in ends[0] if e in of_b]
        common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        groups, last = [], 0
        for end in common:
            sides = [",".join(str(i) for e, i in own if last < e <= end) for own in ends] if len(a) < 3500 else None
            groups.append("|".join(sides) if sides else None)
            last = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and None not in groups else ""
        docs.append((len(a), len(b), len(common), links, digest))
    counts = Counter(pair for d in docs for pair in d[3])
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [
        (na, nb, n, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest)
        for na, nb, n, links, digest in docs
    ]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_alignment_equals_brute_force(spark, bound):
    rng = random.Random(4)
    texts = [*TEXTS, "", None]
    texts += ["".join(rng.choices("aé ñ東\n1.🙂 the", k=rng.randint(1, 80))) for _ in range(40)]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(None, TEXTS[0], "", 0), (3, TEXTS[3], "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, codes int").repartition(3)
    found = T.align(docs, broadcast_rows=bound)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows]), strict=True)]
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:7] == w[:7]
        assert not w[7] or g[7] == w[7]


def test_texts_that_do_not_come_back_have_no_tokens():
    assert not any(map(len, PAIR.encode("")))
    assert not any(map(len, PAIR.encode(None)))
    changed = PAIR.of_b._replace(parts=[b"?"] * len(PAIR.of_b.parts))
    before = PAIR.of_b
    try:
        PAIR.of_b = changed
        assert not any(map(len, PAIR.encode("words")))
        assert T.encoded_row(PAIR, "words") == (0, 0, 0, 0, "", [], [])
    finally:
        PAIR.of_b = before


def test_both_ways_of_tokenizer_a_agree():
    rng = random.Random(9)
    assert PAIR.fast is not None
    spread = [chr(c) for c in range(1, 0x3000, 7)] + [chr(c) for c in range(0x10000, 0x20000, 97)]
    texts = TEXTS + ["".join(rng.choices(spread + list(" \n'st"), k=60)) for _ in range(300)]
    for text in texts:
        assert PAIR.fast.encode_ordinary(f" {text}") == PAIR.a.encode(f" {text}", add_special_tokens=False).ids


def test_very_long_white_space():
    ids_a, ids_b = PAIR.encode(" " * 2_000_000)
    assert len(ids_a) and len(ids_b)


def test_groups_of_several_tokens():
    a, b = T.slices(np.array([2, 1, 3, 1]), np.array([3, 1, 2, 1]))
    assert (a.tolist(), b.tolist()) == ([2, 3, 4], [1, 3, 4])
    assert T.groups_text(PAIR, np.array([9, 8, 7, 6]), np.array([1, 2, 3, 4]), (a, b)) == "9,8|1;7|2,3;6|4"
    assert not any(map(len, T.slices(T.NO_IDS, T.NO_IDS)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.align(docs).collect() == []
