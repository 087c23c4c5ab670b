r"""SimHash near-duplicates, linked with pivot distance tables.

A fingerprint has a bit set if it is set in over half of the hashes of a text's
shingles. Texts link when their fingerprints differ in at most ``MAX_BITS`` bits, and
linked texts form components.

Linking works on distinct fingerprints. Two fingerprints that differ in at most four
bits agree on some of the blocks the 64 bits are cut into, so each fingerprint is
listed under every choice of blocks; how many blocks are cut follows from the number
of fingerprints and changes the work, never the links. Each list has a pivot, its
member with the most documents. Members within reach of the pivot are linked to it and
never compared with each other, so a dense group of near copies costs one distance
each. The other members are compared with their list: pairs whose distances to any of
the fixed reference fingerprints or to the pivot differ by more than ``MAX_BITS`` are
discarded (the triangle inequality), and what is left is verified bit by bit, in the
first list that a pair shares.

A list with more than ``MAX_FAR`` members out of reach of its pivot is not compared. The
bits its members need not share are cut into blocks in turn, and its members are listed
anew under every choice of those: a pair that differs in four bits still agrees on two of
six blocks, so finer lists lose no link. Fingerprints and groups that hold more than one
in ``HOT`` of the documents, ``HOT`` of them at most, are salted where documents are
joined with them.

Defined cases: a null text has no words; a text without words has fingerprint zero and
links like any other; one with fewer words than a shingle has its whole sequence as
its only shingle; repeated rows are documents of one fingerprint; a component is named
by its smallest id, null ids are never the smallest.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas.llm.components import components
from moveatlas.llm.text import ship, stored, with_hint

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Blocks cut, blocks that stay equal under four changed bits.
CUTS = ((5, 1), (6, 2), (7, 3), (8, 4))
REFERENCES = 8
LIST = ["list", "mask", "key"]
#: Members out of reach of the pivot beyond which a list is cut further, and how often.
MAX_FAR = 1_000
MAX_SPLITS = 3
FINER = (6, 2)
HOT, SALTS = 256, 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as an unsigned number."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(shingle, len(found))
    digest = xxhash.xxh64_intdigest
    codes = [
        digest(line[a:b], SEED)
        for a, b in zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    ]
    raw = np.array(codes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(codes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fingerprint`` (signed 64 bits) instead of the text."""

    @F.pandas_udf("long")
    def read(texts: pd.Series) -> pd.Series:
        prints = [fingerprint(t if isinstance(t, str) else None, shingle) for t in texts]
        return pd.Series(np.array(prints, np.uint64).view(np.int64))

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "fingerprint")]
    return docs.select(*rest, read(F.col(text)).alias("fingerprint"))


def _masks(blocks: int, equal: int, fixed: int = 0) -> list[int]:
    """``fixed`` plus each choice of ``equal`` of ``blocks`` nearly even blocks of the other bits."""
    free = [b for b in range(64) if not fixed >> b & 1]
    edges = [round(len(free) * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in free[a:z]) for a, z in zip(edges, edges[1:], strict=False)]
    return [fixed + sum(chosen) for chosen in combinations(parts, equal)]


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _cut_for(count: int) -> tuple[int, int]:
    """The cut with the fewest listed rows plus expected chance pairs."""

    def cost(cut: tuple[int, int]) -> float:
        blocks, equal = cut
        lists = len(_masks(*cut))
        return lists * (count + count * count / 2.0 ** (1 + 64 * equal / blocks))

    return min(CUTS, key=cost)


def _reference(i: int) -> int:
    return _signed(xxhash.xxh64_intdigest(f"reference {i}".encode(), SEED))


def _with_distances(listed: DataFrame) -> DataFrame:
    """Members of lists of two or more with their pivot and all distances."""
    pivots = listed.groupBy(*LIST).agg(
        F.count("*").alias("members"), F.max(F.struct("n", "fp"))["fp"].alias("pivot")
    ).where(F.col("members") > 1)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))).cast("int")
    member = listed.join(pivots, LIST).select(
        *LIST, "fp", "n", "members", "pivot", near.alias("near"),
        *[F.bit_count(F.col("fp").bitwiseXOR(F.lit(_reference(i)))).cast("int").alias(f"d{i}") for i in range(REFERENCES)],
    )
    return stored(member, "pivot-distances")


def _crowded(member: DataFrame, max_far: int) -> DataFrame | None:
    """The lists with more than ``max_far`` members out of reach of the pivot."""
    far = member.where((F.col("members") > max_far) & (F.col("near") > MAX_BITS)).groupBy(*LIST)
    crowded = stored(far.agg(F.count("*").alias("far")).where(F.col("far") > max_far).select(*LIST), "crowded-lists")
    return None if crowded.isEmpty() else crowded


def _finer_lists(member: DataFrame, crowded: DataFrame) -> DataFrame:
    """Members of crowded lists under every choice of blocks of the bits left."""
    held = [row.mask for row in crowded.select("mask").distinct().collect()]
    finer = member.sparkSession.createDataFrame(
        [(m, _signed(f)) for m in held for f in _masks(*FINER, m % 2**64)], "mask long, finer long"
    )
    inside = member.join(with_hint(crowded), LIST, "left_semi").join(F.broadcast(finer), "mask")
    return inside.select(
        "fp", "n", "list", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key")
    )


def _compare(member: DataFrame, masks: list[int]) -> DataFrame:
    """Links of every list: to the pivot, or between verified members."""
    to_pivot = member.where((F.col("near") <= MAX_BITS) & (F.col("fp") != F.col("pivot")))
    far = member.where(F.col("near") > MAX_BITS).alias("a")
    other = member.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.lit(len(masks))
    for i, mask in reversed(list(enumerate(masks))):
        first = F.when(x.bitwiseAND(F.lit(mask)) == 0, F.lit(i)).otherwise(first)
    close = F.col("a.fp") != F.col("b.fp")
    for name in LIST:
        close = close & (F.col(f"a.{name}") == F.col(f"b.{name}"))
    close = close & ((F.col("b.near") <= MAX_BITS) | (F.col("a.fp") < F.col("b.fp")))
    for name in ("near", *[f"d{i}" for i in range(REFERENCES)]):
        close = close & (F.abs(F.col(f"a.{name}") - F.col(f"b.{name}")) <= MAX_BITS)
    close = close & (F.bit_count(x) <= MAX_BITS) & (first == F.col("a.list"))
    checked = far.join(other, close).select(F.col("a.fp").alias("v"), F.col("b.fp").alias("u"))
    return to_pivot.select(F.col("fp").alias("v"), F.col("pivot").alias("u")).unionByName(checked)


def near_pairs(prints: DataFrame, cut: tuple[int, int] | None = None, *, max_far: int = MAX_FAR) -> DataFrame:
    """Edges (v, u) between fingerprints that connect all pairs within ``MAX_BITS``.

    ``prints``: distinct fp with n, its number of documents. Edges can repeat.
    """
    masks = [_signed(m) for m in _masks(*(cut or _cut_for(prints.count())))]
    listed = prints.select("fp", "n", F.posexplode(F.array(*map(F.lit, masks))).alias("list", "mask"))
    listed = listed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    edges = []
    for level in range(MAX_SPLITS + 1):
        member = _with_distances(listed)
        crowded = _crowded(member, max_far) if level < MAX_SPLITS else None
        if crowded is None:
            edges.append(_compare(member, masks))
            break
        edges.append(_compare(member.join(with_hint(crowded), LIST, "left_anti"), masks))
        listed = _finer_lists(member, crowded)
    return reduce(DataFrame.unionByName, edges)


def _join_hot(rows: DataFrame, column: str, one: DataFrame, counts: DataFrame) -> DataFrame:
    """Left join of ``rows`` with ``one`` (one row a __key), hot values of ``column`` salted.

    ``counts``: __key and n, the rows that hold it.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * HOT > total).select(F.col("__key").alias("__hot")))
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    many = rows.withColumn("__deal", dealt).join(hot, F.col(column) == F.col("__hot"), "left")
    many = many.withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(F.col("__deal"))).drop("__hot", "__deal")
    salts = F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    few = one.join(hot, F.col("__key") == F.col("__hot"), "left")
    few = few.withColumn("__copy", F.explode(salts)).drop("__hot")
    joined = many.join(few, (F.col(column) == F.col("__key")) & (F.col("__salt") == F.col("__copy")), "left")
    return joined.drop("__key", "__salt", "__copy")


def group_documents(prints: DataFrame) -> DataFrame:
    """``prints`` (with fingerprint; stored) plus ``root``, one value per component."""
    by_print = stored(
        prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.count("*").alias("n")), "fingerprints"
    )
    stars = components(near_pairs(by_print)).select(F.col("v").alias("__key"), F.col("u").alias("__root"))
    joined = _join_hot(prints, "fingerprint", stars, by_print.withColumnRenamed("fp", "__key"))
    return joined.withColumn("root", F.coalesce("__root", "fingerprint")).drop("__root")


def with_component(grouped: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Add ``component_id``, the smallest key of every root."""
    least = grouped.groupBy(F.col("root").alias("__key")).agg(F.min(key).alias("component_id"), F.count("*").alias("n"))
    least = stored(least, "component-ids")
    return _join_hot(grouped, "root", least.drop("n"), least.select("__key", "n"))


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """One row per document: doc_id, fingerprint (signed) and component_id."""
    prints = stored(
        fingerprints(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), shingle=shingle),
        "prints",
    )
    grouped = stored(group_documents(prints), "print-groups")
    return with_component(grouped).select("doc_id", "fingerprint", "component_id")


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def drop_near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``docs`` with one row left of every component: the one of the smallest key.

    Null keys come last; ties go by the row's content, and equal rows are one document.
    """
    rows = docs.withColumns({"__tie": F.xxhash64(*docs.columns), "__row": F.monotonically_increasing_id()})
    rows = stored(rows, "near-rows")
    light = rows.select(F.col(key).alias("__doc"), "__tie", "__row", F.col(text).alias("__text"))
    grouped = group_documents(stored(fingerprints(light, text="__text", shingle=shingle), "prints"))
    rank = F.struct(F.col("__doc").isNull(), F.col("__doc"), F.col("__tie"), F.col("__row").alias("row"))
    kept = stored(grouped.groupBy("root").agg(F.min(rank)["row"].alias("__row")).select("__row"), "near-kept")
    return rows.join(with_hint(kept), "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


ship(__name__)
