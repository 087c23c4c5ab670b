r"""Benchmark decontamination with a set of normalised test n-grams.

Benchmark items and documents are reduced to the same words (A-Z lower-cased, runs
of digits, letters and non-ASCII characters). A window is 13 consecutive words of an
item, or the whole item if it is shorter. The hashes of all benchmark windows form a
set that travels with the plan; every document is scanned in place, each hash hit is
verified against the window's words, and the words inside verified windows are hit.
Nothing is shuffled for documents without hits.

The set is used in the plan up to ``MAX_SET`` windows. Of a larger benchmark, a bit
filter of the hashes (16 bits a window, at most ``MAX_BITS``) travels with the plan: it
drops nearly all windows of clean documents in place, and only those it lets through are
joined with the set, which is broadcast up to ``MAX_BROADCAST`` windows. The result is
the same either way; the bounds only change the cost.

Defined cases: null or empty texts have no words; items without words have no
window; items of one id count once, a null id is written ``null``; repeated documents
are judged each on its own; an empty benchmark hits nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas.llm.text import apart, ascii_lower, let, present, stored, with_hint

WINDOW = 13
MAX_SET = 20_000
MAX_BROADCAST = 200_000
#: Bits of the filter: 16 MB at most, in arrays of ``CHUNK`` longs.
MAX_BITS = 2**27
CHUNK = 4096
#: A document is contaminated if this many times its hit words reach all its words.
HIT_FACTOR = 20
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """Lower-cased words; none for null."""
    return F.filter(F.split(ascii_lower(present(text)), BETWEEN), lambda w: w != "")


def benchmark_windows(
    benchmark: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """item, n, gram, code: the distinct windows of every item."""
    named = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"),
        plain_words(F.col(text)).alias("w"),
    ).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    own = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))
    windows = named.select("item", n.alias("n"), F.explode(own).alias("own"))
    return windows.select(
        "item", "n", F.array_join("own", " ").alias("gram"), F.xxhash64("own").alias("code")
    ).distinct()


@dataclass(frozen=True)
class GramSet:
    """Benchmark windows by length; beyond the bound a bit filter stands for ``grams``."""

    windows: DataFrame
    lengths: tuple[int, ...]
    grams: dict[int, list[tuple[int, str]]] | None
    bits: DataFrame | None = None
    n_bits: int = 0


def _places(code: Column, n_bits: int) -> list[tuple[Column, Column]]:
    """The two places of a hash in the filter: number of the long, and its bit."""
    last = F.lit(n_bits // 64 - 1).cast("long")
    return [
        (F.shiftrightunsigned(code, at).bitwiseAND(last), F.shiftrightunsigned(code, bit).bitwiseAND(F.lit(63)).cast("int"))
        for at, bit in ((6, 0), (30, 52))
    ]


def bit_filter(codes: DataFrame, n_bits: int) -> DataFrame:
    """One row: the filter as an array of arrays of ``CHUNK`` longs."""
    places = F.explode(F.array(*[F.struct(at.alias("at"), bit.alias("bit")) for at, bit in _places(F.col("code"), n_bits)]))
    longs = (
        codes.select(places.alias("p")).groupBy(F.col("p.at").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits"))
    )
    every = codes.sparkSession.range(n_bits // 64).select(F.col("id").alias("at")).join(longs, "at", "left")
    chunks = every.groupBy(F.floor(F.col("at") / CHUNK).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0)).alias("bits"))))["bits"].alias("bits")
    )
    return chunks.agg(F.sort_array(F.collect_list(F.struct("chunk", "bits")))["bits"].alias("bits"))


def may_hold(bits: Column, code: Column, n_bits: int) -> Column:
    """Whether both places of the hash are set."""
    tests = [
        F.getbit(F.get(F.get(bits, F.floor(at / CHUNK).cast("int")), (at % CHUNK).cast("int")), bit) == 1
        for at, bit in _places(code, n_bits)
    ]
    return tests[0] & tests[1]


def gram_set(benchmark: DataFrame, *, max_set: int = MAX_SET, **columns) -> GramSet:
    """Collect the window set if it stays within ``max_set``."""
    windows = stored(benchmark_windows(benchmark, **columns), "benchmark-windows")
    distinct = windows.select("n", "code", "gram").distinct()
    lengths = tuple(sorted(r.n for r in windows.select("n").distinct().collect()))
    n_grams = distinct.count()
    if n_grams > max_set:
        n_bits = min(max(64 * CHUNK, 1 << (16 * n_grams - 1).bit_length()), MAX_BITS)
        bits = stored(bit_filter(distinct.select("code"), n_bits), "benchmark-bits")
        return GramSet(windows, lengths, None, bits, n_bits)
    grams: dict[int, list[tuple[int, str]]] = {n: [] for n in lengths}
    for row in distinct.sort("gram").collect():
        grams[row.n].append((row.code, row.gram))
    return GramSet(windows, lengths, grams)


def _found(n: int, grams: list[tuple[int, str]]) -> str:
    """SQL for the windows of ``n`` words of the array ``w`` that the set holds."""
    starts = f"IF(size(w) >= {n}, sequence(1, size(w) - {n} + 1), array())"
    codes = ", ".join(f"{code}L" if code > -(2**63) else "-9223372036854775807L - 1L" for code, _ in grams)
    texts = ", ".join("'" + gram.replace("\\", "\\\\").replace("'", "\\'") + "'" for _, gram in grams)
    starts = (
        f"filter({starts}, i -> xxhash64(slice(w, i, {n})) IN ({codes})"
        f" AND array_join(slice(w, i, {n}), ' ') IN ({texts}))"
    )
    return (
        f"transform({starts}, i -> named_struct('pos', i, 'n', {n},"
        f" 'gram', array_join(slice(w, i, {n}), ' ')))"
    )


def _codes(w: Column, n: int) -> Column:
    """pos, n and hash of every window of ``n`` words."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.xxhash64(F.slice(w, i, F.lit(n))).alias("code"))
    )


NO_HITS = "CAST(array() AS array<struct<pos:int,n:int,gram:string>>)"


def _scan_large(docs: DataFrame, found: GramSet, text: str) -> DataFrame:
    """``scan_hits`` with a set too large for the plan.

    Hashes are filtered in place, those let through are joined with the set as hashes,
    and the words of what is left are compared.
    """
    rows = stored(docs.withColumns({"__row": F.monotonically_increasing_id()}), "decontaminate-rows")
    grams = stored(found.windows.select("n", "code", "gram").distinct(), "benchmark-grams")
    words = plain_words(F.col(text))
    codes = let(words, lambda w: F.concat(*[_codes(w, n) for n in found.lengths]))
    hashed = (
        rows.select("__row", F.inline(codes))
        .where(may_hold(found.bits.scalar(), F.col("code"), found.n_bits))
        .join(with_hint(grams.select("n", "code").distinct(), MAX_BROADCAST), ["n", "code"], "left_semi")
    )
    by_row = stored(
        hashed.groupBy("__row").agg(F.collect_list(F.struct("pos", "n")).alias("__places")), "decontaminate-places"
    )
    compared = (
        rows.select("__row", words.alias("w")).join(by_row, "__row")
        .select("__row", F.explode(F.transform(
            "__places",
            lambda p: F.struct(
                p["pos"].alias("pos"), p["n"].alias("n"), F.array_join(F.slice("w", p["pos"], p["n"]), " ").alias("gram")
            ),
        )).alias("h"))
        .select("__row", "h", F.col("h.n").alias("n"), F.col("h.gram").alias("gram"))
        .join(with_hint(grams.select("n", "gram"), MAX_BROADCAST), ["n", "gram"], "left_semi")
    )
    real = compared.groupBy("__row").agg(F.collect_list("h").alias("__hits"))
    back = rows.withColumn("n_words", F.size(words).cast("long")).join(real, "__row", "left")
    return back.withColumn("hits", F.coalesce("__hits", F.expr(NO_HITS))).drop("__row", "__hits")


def scan_hits(docs: DataFrame, found: GramSet, *, text: str = "text") -> DataFrame:
    """``docs`` plus ``n_words`` and ``hits``: pos, n and gram of every verified window."""
    if found.grams is None:
        return _scan_large(docs, found, text)
    read = docs.withColumn("__words", plain_words(F.col(text)))
    parts = [_found(n, found.grams[n]) for n in found.lengths]
    every = f"concat({', '.join([NO_HITS, *parts])})"
    return read.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "hits": F.expr(f"transform(array(__words), w -> {every})[0]"),
        }
    ).drop("__words")


def hit_words(hits: Column) -> Column:
    """Number of words inside any hit."""
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("until"))

    def add(at: Column, hit: Column) -> Column:
        end = hit["pos"] + hit["n"]
        new = F.greatest(F.lit(0), end - F.greatest(at["until"], hit["pos"]))
        return F.struct(
            (at["covered"] + new).alias("covered"), F.greatest(at["until"], end).alias("until")
        )

    return F.aggregate(F.sort_array(hits), start, add, lambda at: at["covered"].cast("long"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * HIT_FACTOR >= n_words)


def cut_hits(text: Column, hits: Column) -> Column:
    """The text without its hit words; what stands between words stays."""
    words = F.regexp_extract_all(text, F.lit(ANY_CASE_WORD), F.lit(0))
    between = F.split(text, ANY_CASE_WORD)

    def kept(word: Column, i: Column) -> Column:
        inside = F.exists(hits, lambda h: (i + 1 >= h["pos"]) & (i + 1 < h["pos"] + h["n"]))
        return F.when(inside, F.lit("")).otherwise(word)

    pairs = F.zip_with(
        between, F.transform(words, kept), lambda b, w: F.concat(present(b), present(w))
    )
    return F.when(F.size(hits) == 0, text).otherwise(F.array_join(pairs, ""))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, action: str = "drop", text: str = "text", **columns
) -> DataFrame:
    """Drop contaminated documents, or cut hit words out of all documents.

    The result has the columns of ``docs``.
    """
    if action not in ("drop", "cut"):
        raise ValueError(f"action is drop or cut, not {action!r}")
    grams = gram_set(benchmark, **columns)

    def clean(rows: DataFrame) -> DataFrame:
        found = scan_hits(rows, grams, text=text)
        if action == "drop":
            return found.where(~is_contaminated(hit_words(F.col("hits")), F.col("n_words")))
        return found.withColumn(text, cut_hits(F.col(text), F.col("hits")))

    return apart(docs, ("n_words", "hits"), clean)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    max_set: int = MAX_SET,
    **columns,
) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, verdict."""
    found = gram_set(benchmark, max_set=max_set, **columns)
    scanned = scan_hits(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), found)
    rows = stored(
        scanned.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_words",
            hit_words(F.col("hits")).alias("n_hit"),
            F.array_distinct(F.transform("hits", lambda h: h["gram"])).alias("grams"),
        ),
        "contamination",
    )
    items = (
        rows.select("row", F.explode("grams").alias("gram"))
        .join(found.windows.select("gram", "item").distinct(), "gram")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.join(items, "row", "left").select(
        "doc_id", "n_words", "n_hit", F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
