"""Every registered query and the pipeline over the smallest tables, against SQL or brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
import xxhash
from oracle import differences, duck
from test_operators import plain, print_brute, suffix_brute, words_of
from test_secret_scan import brute_base
from test_simhash_lists import kept_brute
from test_token_alignment import brute as aligned

import __spark_entry__ as contract
import corpus_pipeline
from moveatlas.llm import quality_rules, url_filter
from moveatlas.llm.queries import QUERIES
from moveatlas.llm.sql import ORACLES


@pytest.fixture(scope="module")
def tables(small):
    """Tables as lists of rows, read without Spark."""
    con = duck(small)

    def read(name):
        found = con.execute(f"SELECT * FROM {name}")
        names = [d[0] for d in found.description]
        return [dict(zip(names, row, strict=True)) for row in found.fetchall()]

    return {name: read(name) for name in ("documents", "pages", "benchmark", "labels", "conversations")}


def run(spark, small, name):
    return [r.asDict() for r in QUERIES[name](spark, small).collect()]


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    want = duck(small).execute(ORACLES[name]).fetchdf()
    assert differences(QUERIES[name](spark, small).toPandas(), want) is None


class Article(HTMLParser):
    """The blocks of the one article of a page of the test tables."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag in ("p", "h1"):
            self.blocks.append("") if self.inside else None
        elif tag == "br" and self.inside:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_extraction_equals_the_articles(spark, small, tables):
    got = {r["page_id"]: r for r in run(spark, small, "op1_html_extract")}
    assert len(got) == len(tables["pages"])
    for page in tables["pages"]:
        reader = Article()
        reader.feed(page["html"])
        text = "\n".join(b for b in (" ".join(b.split()) for b in reader.blocks) if b)
        row = got[page["page_id"]]
        assert (row["text"], row["n_chars"], row["url"]) == (text, len(text), page["url"])


def url_classes(url):
    fixed = {ord(c): i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789./")}
    upper = {b - 32: i for b, i in fixed.items() if 97 <= b <= 122}
    return [39] * 3 + [{**fixed, **upper}.get(b, 38) for b in (url or "").encode()]


def witten_bell(urls):
    """P(class | up to three classes before), by recursion over context counts."""
    follow = defaultdict(Counter)
    for url in urls:
        found = url_classes(url)
        for i in range(3, len(found)):
            for order in range(4):
                follow[tuple(found[i - order : i])][found[i]] += 1
    known = {}

    def probability(context, c):
        if (context, c) not in known:
            shorter = probability(context[1:], c) if context else 1 / 40
            counts = follow.get(context, Counter())
            n, kinds = sum(counts.values()), len(counts)
            known[context, c] = (counts[c] + kinds * shorter) / (n + kinds) if n else shorter
        return known[context, c]

    return probability


def test_url_scores_threshold_and_verdicts(spark, small, tables):
    rows = run(spark, small, "op5_url_filter")
    urls = {p["page_id"]: p["url"] for p in tables["pages"]}
    assert len(rows) == len(urls)
    train, held = {True: [], False: []}, []
    for r in rows:
        url = urls[r["page_id"]]
        rest = url.split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [
            x.rule for x in url_filter.RULES
            if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)
        ]
        rule = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if rule:
            allowed = rule in ("example.net/en/", "org/fr/")
            assert r["verdict"] == ("allow" if allowed else "block")
            code = xxhash.xxh64_intdigest(url.encode(), 42)
            fold = (code - 2**64 if code >= 2**63 else code) % url_filter.FOLDS
            held.append((r["score"], allowed)) if fold == 0 else train[allowed].append(url)
    good, bad = witten_bell(train[True]), witten_bell(train[False])
    for r in rows:
        found = url_classes(urls[r["page_id"]])
        steps = [(tuple(found[i - 3 : i]), found[i]) for i in range(3, len(found))]
        want = sum(math.log(good(*s)) - math.log(bad(*s)) for s in steps) / len(steps)
        assert r["score"] == pytest.approx(want, abs=1e-5)

    def errors(edge):
        wrong = Counter((good, math.floor(s / url_filter.BIN) >= edge) for s, good in held)
        n = Counter(good for _, good in held)
        return wrong[True, False] / n[True] + wrong[False, True] / n[False]

    bins = {math.floor(s / url_filter.BIN) for s, _ in held}
    edges = sorted(bins | {b + 1 for b in bins} | {0})
    both = len({g for _, g in held}) == 2
    threshold = min((errors(e), abs(e), e) for e in edges)[2] * url_filter.BIN if both else 0.0
    for r in rows:
        if not r["rule"]:
            assert r["verdict"] == ("allow" if r["score"] >= threshold else "block")


def test_repeats_equal_brute_force(spark, small, tables):
    rows = run(spark, small, "op4_suffix_dedup")
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in rows)
    assert got == sorted(suffix_brute([(d["doc_id"], d["text"]) for d in tables["documents"]]))


def test_fingerprints_and_components(spark, small, tables):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, small, "op7_simhash")}
    prints = {d["doc_id"]: print_brute(d["text"]) for d in tables["documents"]}
    root = {i: i for i in prints}
    for i in sorted(prints):
        for j in sorted(prints):
            if j < i and root[i] != root[j] and (prints[i] ^ prints[j]).bit_count() <= 4:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_pseudonyms_keep_all_else_and_stay_linked(spark, small, tables):
    """Only spans of digits, letters of account numbers and addresses change; formats stay."""
    texts = {d["doc_id"]: d["text"] for d in tables["documents"]}
    rows = run(spark, small, "op9_pseudonyms")
    assert len(rows) == len(texts) and sum(r["n_changed"] for r in rows) > 0
    linked = {}
    for r in rows:
        old, new = texts[r["doc_id"]] or "", r["text"] or ""
        assert r["n_changed"] <= r["n_found"] and (r["n_changed"] > 0) == (old != new)
        if not re.search("[0-9@]", old):
            assert old == new
        for a, b in zip(re.findall(r"\d{4}-\d\d-\d\d", old), re.findall(r"\d{4}-\d\d-\d\d", new)):
            assert linked.setdefault(a, b) == b
    assert len(set(linked.values())) == len(linked)


def stats_brute(text):
    w, lines = words_of(text), (text or "").split("\n")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    hit = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 3)}
    full = [x for x in lines if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(hit)


def features_brute(text):
    n_words, chars, symbols, dup, rep = stats_brute(text)
    t, w = text or "", max(1, n_words)
    lines = max(1, sum(1 for x in t.split("\n") if words_of(x)))
    return {
        "n_words": n_words, "chars_per_word": chars / w, "symbols_per_word": symbols / w,
        "dup_line_share": dup / lines, "repeat_share": rep / w,
        "upper_share": len(re.findall("[A-Z]", t)) / max(1, chars),
        "marks_per_word": sum(c in "!?:;/=@_{}[]()" for c in t) / w, "words_per_line": n_words / lines,
    }


def verdict_brute(text, rules):
    """(base_failed, number of the first rule that covers the text)."""
    n_words, _, _, _, rep = stats_brute(text)
    x = features_brute(text)

    def covers(rule):
        return all((x[c.feature] > c.threshold) == c.above for c in rule)

    number = next((i for i, rule in enumerate(rules, 1) if covers(rule)), 0)
    return n_words < 50 or 100 * rep > 50 * n_words, number


@pytest.fixture(scope="module")
def rules(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    return quality_rules.fit_rules(docs, labels)


def test_quality_verdicts(spark, small, tables, rules):
    got = {r["doc_id"]: r for r in run(spark, small, "op10_quality_rules")}
    assert rules and len(got) == len(tables["documents"])
    for d in tables["documents"]:
        r = got[d["doc_id"]]
        stats = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert stats == stats_brute(d["text"])
        failed, number = verdict_brute(d["text"], rules)
        assert (r["base_failed"], r["rule"], r["kept"]) == (failed, number, not failed and not number)


def test_alignment_counts(spark, small, tables):
    rows = run(spark, small, "op12_token_alignment")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in rows}
    docs = tables["documents"]
    for d, want in zip(docs, aligned([d["text"] for d in docs]), strict=True):
        assert got[d["doc_id"]][:6] == want[:6] and want[6] in ("", got[d["doc_id"]][6])


def test_secrets_of_the_base(spark, small, tables):
    got = {r["doc_id"]: r for r in run(spark, small, "op13_secret_scan")}
    order = ("assign", "access", "hex")
    for d in tables["documents"]:
        found = brute_base(d["text"] or "")
        spans = [f"{k}:{a}:{b}" for a, _, b, k in sorted((a, order.index(k), b, k) for k, a, b, _ in found)]
        r = got[d["doc_id"]]
        assert [r[f"n_{k}"] for k in order] == [sum(x[0] == k for x in found) for k in order]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def lines_brute(rows):
    """Texts without the lines that over 5 % and 10 or more of a site's distinct pages hold."""
    pages = defaultdict(set)
    for _, text, site in rows:
        if text is not None:
            pages[site].add(text)
    often = {}
    for site, found in pages.items():
        n = Counter(line for t in found for line in {x.strip(" \t\r") for x in t.split("\n")} - {""})
        often[site] = {line for line, k in n.items() if k >= 10 and k > 0.05 * len(found)}
    for i, text, site in rows:
        kept = text if text is None else "\n".join(x for x in text.split("\n") if x.strip(" \t\r") not in often[site])
        yield i, kept, site


def contaminated_brute(text, items):
    w = plain(text)
    grams = defaultdict(set)
    for g in map(plain, items):
        n = min(13, len(g))
        if n:
            grams[n] |= {tuple(g[i : i + n]) for i in range(len(g) - n + 1)}
    hit = {k for n, s in grams.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in s for k in range(i, i + n)}
    return bool(hit) and 20 * len(hit) >= len(w)


def odd_documents(spark, tables):
    """The smallest documents and rows with nulls, repeats, long and empty texts, clashing columns."""
    rows = [(d["doc_id"], d["text"], d["source"]) for d in tables["documents"]]
    long = next(t for _, t, _ in rows if t and len(t) > 2000)
    fresh = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows += [(None, None, None), (None, long + " more", "src0"), (9001, "", "src1"), (9002, fresh, None), rows[5], rows[5]]
    frame = spark.createDataFrame(
        [(*r, "clash", 1, True) for r in rows], "doc_id long, text string, source string, n_words string, n_lines int, hits boolean"
    )
    return frame.repartition(4), rows


def test_pipeline_stages_equal_brute_force(spark, small, tables, rules):
    docs, rows = odd_documents(spark, tables)

    def key(found):
        return sorted(found, key=repr)

    def own(frame):
        assert frame.columns == docs.columns
        return key((r.doc_id, r.text, r.source) for r in frame.collect())

    learned = quality_rules.fit_rules(docs, spark.read.parquet(f"{small}/labels.parquet"))
    want = [r for r in rows if verdict_brute(r[1], learned) == (False, 0)]
    assert 0 < len(want) < len(rows)
    assert own(corpus_pipeline.quality(spark, docs, small)) == key(want)

    assert own(corpus_pipeline.lines(spark, docs, small)) == key(lines_brute(rows))

    left = own(corpus_pipeline.near_duplicates(spark, docs, small))
    assert sorted((r[0] is None, r[0] or 0) for r in left) == kept_brute([r[:2] for r in rows])

    items = [b["text"] for b in tables["benchmark"]]
    want = [r for r in rows if not contaminated_brute(r[1], items)]
    assert own(corpus_pipeline.benchmark(spark, docs, small)) == key(want) and len(want) < len(rows)

    mixed = corpus_pipeline.mix(spark, docs, small).collect()
    by_source = defaultdict(list)
    for r in mixed:
        assert r.size == len(words_of(r.text)) and r.taken == r.copies * r.size and 0 < r.copies <= 3
        by_source[r.source].append(r)
    for found in by_source.values():
        longest = max(len(words_of(t)) for _, t, s in rows if s == found[0].source)
        assert abs(sum(r.taken for r in found) - found[0].target) <= 2 * longest


def test_stages_of_an_empty_table(spark, small, tables):
    docs, _ = odd_documents(spark, tables)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0, name


def test_run_applies_the_stages_in_order(spark, small, tables, rules):
    texts = {d["doc_id"]: (d["text"], d["source"]) for d in tables["documents"]}
    rows = [(i, *t) for i, t in texts.items() if verdict_brute(t[0], rules) == (False, 0)]
    rows = list(lines_brute(rows))
    kept = {k for null, k in kept_brute([r[:2] for r in rows]) if not null}
    items = [b["text"] for b in tables["benchmark"]]
    rows = {r[0]: r for r in rows if r[0] in kept and not contaminated_brute(r[1], items)}
    got = corpus_pipeline.run(spark, small).collect()
    assert got and len({r.doc_id for r in got}) == len(got)
    for r in got:
        assert (r.doc_id, r.text, r.source) == rows[r.doc_id] and r.n_chars == len(r.text)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    for r in got:
        longest = max(len(words_of(t)) for _, t, s in rows.values() if s == r.source)
        assert abs(taken[r.source] - r.target) <= 2 * longest
