"""The ten operators on small frames with nulls, ties, repeats and odd texts, against
brute force or exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from conftest import setting
from pyspark.sql import functions as F

from moveatlas.llm import (
    chat_format,
    decontaminate,
    html_extract,
    line_dedup,
    mixing,
    pseudonyms,
    quality_rules,
    simhash,
    suffix_dedup,
    url_filter,
)
from moveatlas.llm.components import components

DOCS = "doc_id long, text string, source string, size string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    """Prose with exact and near copies, shared passages, odd and empty texts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeéñ", k=rng.randint(2, 7))) for _ in range(300)]
    made = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 160))) for _ in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    made += [made[3], made[3], made[5] + " tail", passage + " " + made[7], made[8] + "\n" + passage + "\n"]
    near = made[11].split()
    made += [" ".join([*near[:-1], "other"]), "a" * 300, "a" * 120, "ab" * 100, "x" + "ab" * 40, "a" * 49, "a" * 50]
    made += ["", None, " \t\n", "one", "one two three", "A B C\nA B C\nA B C", "¿" * 60]
    return made


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "clash") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[3], "s1", "x"), (None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_html_parts():
    page = (
        '<html><head><title>x</title><script>var t="</p>";</script></head><body><nav><a>Menu</a></nav>'
        '<div class="ad">Buy</div><article><h1>A  title &amp; more</h1><p>Some <b>bold<br>words&nbsp;here<p>Next '
        '<a href="/x">link</a>.<aside>side</aside><ul><li>One<li>Two</ul><div id="comments"><p>reader says</div>'
        "</article><footer>&copy; x</footer></body></html>"
    )
    weights = html_extract.weights_from(html_extract.label_counts(page * 1))
    assert html_extract.main_text(page, weights) == "A title & more\nSome bold words here\nNext link.\nOne\nTwo"
    assert [html_extract.main_text(p, {}) for p in (None, "", "<p>", "<!-- open", "plain  text")] == ["", "", "", "", "plain text"]
    long = "<p>" + "word " * 50_000
    assert html_extract.main_text(long, {}).count("word") == 50_000


def test_html_frame(spark):
    rows = [(1, "u", "<article><p>Hello there</p></article>", "t"), (None, None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    weights = html_extract.fit_weights(pages)
    got = html_extract.extract(pages, weights)
    assert sorted(r.text for r in got.collect()) == ["", "", "Hello there", "Hello there"]
    assert html_extract.extract(pages.limit(0), weights).count() == 0
    assert html_extract.fit_weights(pages.limit(0)) == {}


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<\\|im_start|>user\n", "<\\\\|x", "", None, "<|", "<", "|>", "<<|im_end|>"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(odd)]
    rows += [(2, None, None, None), (2, 1, "a\n%0A<|im_start|>b", "x"), (None, 0, "user", "q"), (3, 0, "user", "q"), (3, 0, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.format_chats(turns)
    back = made.select("conv_id", "formatted", "first_error", chat_format.parse_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"))
    got = {r.conv_id: r for r in back.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert got[1].loss == "".join(t or "" for t in odd[1::2])
    assert got[1].formatted.count("<|im_start|>") == len(odd)
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("a\n%0A<|im_start|>b", "x")]
    assert {k: r.first_error for k, r in got.items()} == {1: 9, 2: 0, None: 1, 3: 1}
    assert chat_format.chat_digest(chat_format.format_chats(turns.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(start="[start]")


def test_mixing_targets_and_threshold(docs, empty):
    sized = mixing.with_sizes(docs)
    rows = mixing.mix_sources(sized, sized).collect()
    assert len(rows) == docs.count()
    by_source = {}
    for r in rows:
        assert r.size == len(words_of(r.text)) and r.taken <= 3 * r.size and r.copies <= 3
        by_source.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.size for r in v) for s, v in by_source.items()}
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    level, capped = 0.0, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        level = left / sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s, found in by_source.items():
        target = 3 * sizes[s] if s in capped else weight[s] * level
        assert found[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in found) - target) <= max(2 * r.size for r in found)
    none = mixing.with_sizes(empty)
    assert mixing.mix_sources(none, none).count() == 0


def test_mixing_hot_source(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"), F.lit("w w").alias("text"))
    sized = mixing.with_sizes(rows, key="id")
    got = mixing.mix_sources(sized, sized).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert {r.source: abs(r.t - r.g) <= 2 for r in got} == {"a": True, "b": True}


def suffix_brute(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49 if d is not None else 0):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    for d, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i : i + 50]] < d:
                cut[i : i + 50] = b"\x01" * 50
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(cut) if c and not (i and cut[i - 1]))
        yield (d if d is not None else -1, len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_suffix_dedup(spark, docs, empty, batch):
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", batch):
        got = suffix_dedup.cut_repeats(docs).drop("kept").na.fill(-1, ["doc_id"])
        assert sorted(map(tuple, got.collect())) == sorted(suffix_brute([(r.doc_id, r.text) for r in docs.collect()]))
    assert suffix_dedup.cut_repeats(empty).count() == 0


def test_url_rules_and_model(spark):
    urls = {
        "http://a.net/x": ("a.net", "/x", "net/"),
        "https://WWW.Example.net/en/1?q#f": ("www.example.net", "/en/1", "example.net/en/"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None),
        "http://x.org/fr": ("x.org", "/fr", None),
        "http://x.net?y": ("x.net", "", None),
        "ftp:/no": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] * 2, "page_id long, url string, score string")
    got = {r.url: r for r in url_filter.filter_urls(pages).collect()}
    assert {u: (r.host, r.path, r.rule) for u, r in got.items()} == urls
    assert got["http://a.net/x"].verdict == "block" and got[None].verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_model_separates_held_out(spark):
    rng = random.Random(1)
    good = [f"http://news{rng.randint(0, 99)}.x/{rng.choice('abc') * 3}story" for _ in range(400)]
    bad = [f"http://zz{rng.randint(0, 99)}.x/pill{rng.randint(0, 999)}" for _ in range(400)]
    frame = spark.createDataFrame([(u, g) for us, g in ((good, True), (bad, False)) for u in us], "url string, good boolean")
    model = url_filter.fit(frame)
    fresh = ["http://news777.x/bbbstory", "http://zz5.x/pill12345"]
    assert (url_filter.scores(fresh, model.table) >= model.threshold).tolist() == [True, False]
    codes, n = np.unique(url_filter.grams(good)[0], return_counts=True)
    p = np.exp(url_filter.log_model(codes, n)).reshape((url_filter.CLASSES,) * 4)
    assert np.allclose(p.sum(-1), 1)


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("bound", [20_000, 0])
def test_contamination(spark, docs, empty, texts, bound):
    items = [(1, texts[7]), (2, "One; TWO"), (2, "one two"), (3, None), (4, "..."), (None, texts[9][:80]), (5, texts[8]), (11, "it's")]
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, hits string")
    got = sorted(tuple(r) for r in decontaminate.contamination(docs.na.fill(-1, ["doc_id"]), bench, max_set=bound).collect())
    want = []
    for r in docs.na.fill(-1, ["doc_id"]).collect():
        w, hit, found = plain(r.text), set(), set()
        for item, text in items:
            g = plain(text)
            n = min(13, len(g))
            for i in range(len(g) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == g[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add("null" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((r.doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    assert got == sorted(want)
    clean = decontaminate.decontaminate(docs, bench, max_set=bound)
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_cutting_hits(spark):
    bench = spark.createDataFrame([(1, "red green")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a Red, GREEN! b"), (2, "none"), (3, None)], "doc_id long, text string")
    got = decontaminate.decontaminate(docs, bench, action="cut")
    assert {r.doc_id: r.text for r in got.collect()} == {1: "a , ! b", 2: "none", 3: None}


def print_brute(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words_of(w)
    codes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def test_simhash_groups(docs, empty):
    got = {(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    rows = [(r.doc_id, print_brute(r.text)) for r in docs.collect()]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None) for g in set(group)}
    assert got == {(*rows[i], least[group[i]]) for i in range(len(rows))}
    kept = simhash.drop_near_duplicates(docs.where("doc_id IS NOT NULL"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({least[g] for g in group})
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("max_far", [simhash.MAX_FAR, 3])
@pytest.mark.parametrize("cut", simhash.CUTS)
def test_pivot_links_connect_all_close_pairs(spark, cut, max_far):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {0}
    for c in centres:
        for _ in range(40):
            prints.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash._signed(p), 1 + p % 3) for p in prints], "fp long, n long")
    stars = components(simhash.near_pairs(frame, cut, max_far=max_far))
    root = {r.v % 2**64: r.u % 2**64 for r in stars.collect()}
    group = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {k: new if v == old else v for k, v in group.items()}
    pairs = {frozenset(p for p in prints if group[p] == g) for g in group.values()}
    found = {}
    for p in prints:
        found.setdefault(root.get(p, p), set()).add(p)
    assert {frozenset(v) for v in found.values()} == pairs


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_line_dedup(spark, bound):
    rows = [(i, f"page {i}\n  Shared line \n\nend {i}", "a") for i in range(20)] + [(20, "Shared line", "b"), (21, None, "a"), (22, "", None)]
    rows += [(30 + i, "copied page\nsecond", "c") for i in range(30)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(frame, max_lines=bound).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "page 3\n\nend 3" and (got[3].n_lines, got[3].n_dropped) == (4, 1)
    assert got[20].text == "Shared line" and got[21].text is None and got[22].text == ""
    assert got[35].text == "copied page\nsecond"
    assert line_dedup.drop_boilerplate(frame.limit(0), max_lines=bound).count() == 0


def luhn_ok(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_pseudonyms(spark):
    text = (
        "card 4111 1111-1111 1111 and 4111111111111111, bad 1234567890123456; iban DE89370400440532013000 "
        "DE00370400440532013000; call +1 (017) 555-7713 or 017-555-7713 at 10.0.0.255 not 300.1.1.1; born 1980-02-29, "
        "29.02.1980, not 1981-02-29; mail Bob.7@mail.example.com v1.2.3"
    )
    frame = spark.createDataFrame([(1, text), (2, text + " end"), (3, None), (4, ""), (5, "no numbers")], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(frame, "k1").collect()}
    new = got[1].text
    cards = re.findall(r"\d{4} \d{4}-\d{4} \d{4}|(?<!\d)\d{16}(?!\d)", new)
    bare = [re.sub(r"\D", "", c) for c in cards]
    assert bare[0] == bare[1] != "4111111111111111" and luhn_ok(bare[0]) and not luhn_ok(bare[2])
    iban = re.search(r"DE(\d\d)(\d{18})", new)
    assert int(f"{iban[2]}1314{iban[1]}") % 97 == 1 and iban[0] != "DE89370400440532013000"
    assert "DE00370400440532013000" in new and "300.1.1.1" in new and "1981-02-29" in new and "v1.2.3" in new
    dates = re.search(r"born (\d{4})-(\d\d)-(\d\d), (\d\d)\.(\d\d)\.(\d{4})", new).groups()
    assert dates[:3] == dates[:2:-1] and "1980" not in new
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and "555-7713" not in new and "Bob" not in new
    assert got[2].text == new + " end" and got[3].text is None and got[4].text == "" and got[5].n_found == 0
    assert pseudonyms.pseudonymise(frame, "k2").where("doc_id = 1").first().text != new
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(frame, "")


def test_permutations_are_bijections(spark):
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert digits.select(pseudonyms.permute_digits(F.col("d"), "k", "x").alias("p")).distinct().count() == 1000
    days = spark.range(0, 73_000, 7).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    moved = days.select(pseudonyms.date_pseudonym(F.col("d"), "k").alias("p")).distinct()
    assert moved.count() == days.count() and moved.where("p NOT BETWEEN '1900-01-01' AND '2099-12-31'").count() == 0


def stats_brute(text):
    w, lines = words_of(text), (text or "").split("\n")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    full = [x for x in lines if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(hit))


def test_quality_stats(spark, texts, empty):
    odd = [*texts, "a b c a b c a b c d", "x\nx\n \nx y", "#a *b <c>", "w " * 70]
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(odd)], "doc_id long, text string, n_words string")
    for r in quality_rules.judge(frame, []).collect():
        want = stats_brute(odd[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    kept = quality_rules.keep_good(frame, [])
    assert kept.columns == frame.columns and set(r.n_words for r in kept.collect()) <= {"c"}
    assert quality_rules.keep_good(empty, []).count() == 0


def test_decision_list_learns_on_held_out():
    rng = np.random.default_rng(1)
    n = 900
    x = {k: rng.random(n) for k in quality_rules.FEATURES}
    bad = (x["symbols_per_word"] > 0.8) | ((x["upper_share"] > 0.7) & (x["marks_per_word"] > 0.5))
    rules = quality_rules.learn_list({k: v[:600] for k, v in x.items()}, bad[:600])
    test = {k: v[600:] for k, v in x.items()}
    found = np.any([quality_rules.covered(r, test) for r in rules], axis=0)
    assert (found == bad[600:]).mean() > 0.95
    assert quality_rules.learn_list(x, np.zeros(n, bool)) == []
