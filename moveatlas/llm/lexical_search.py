r"""Ranked lexical search with the Best Position Algorithm.

Terms are the maximal runs of digits, letters A-Z (lower-cased) and non-ASCII
characters. A document's score for an item adds up, over the item's terms with
repeats, ``weight * (10^9 tf div (1000 tf + 12 m))``, where the weight falls with the
number of documents that hold the term and m grows with the document's length.

Documents are read once: each leaves its length and how often it holds the items'
terms. Sums over all documents give the weights. Then every task cuts its documents
into shards of bounded memory. A shard holds one impact list per term, documents by
falling contribution, and the position of every document in every list. For an item,
the lists are read from the top, a deeper block each time; every document met is looked
up in all lists of the item, which also marks its positions there as seen. A list's best
position is the end of its run of seen positions from the top. The contributions at the
best positions add up to a bound on all documents not met: reading stops when the bound
is strictly below the k-th best score so far, so documents of equal score are all met.
A task carries its best scores from shard to shard and returns k rows an item; a last
ranking over tasks takes the k best.

The items' terms are the only thing sent to every task. Items are taken in blocks of
at most ``BLOCK_TERMS`` different terms (or one item), one pass over the documents a block.

Defined cases: a null text has no terms; a document without terms counts nowhere; an
item without terms or without matching documents gives no row; repeated document rows
are documents, repeated item rows are items, each with its own ranks; equal scores are
ordered by key, null keys last; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from moveatlas.llm.text import ship, stored

K = 20
#: Different terms of one block of items, and terms added up over its items.
BLOCK_TERMS = 50_000
BLOCK_ENTRIES = 2_000_000
#: Cells of a shard's table of positions, and documents of a shard.
SHARD_CELLS = 24_000_000
SHARD_DOCS = 16_000
#: Positions read from every list at first; each further step reads twice as many.
FIRST_STEP = 32

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ABSENT = np.iinfo(np.uint16).max


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order; ASCII letters only are lower-cased."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if isinstance(text, str) else []


@dataclass(frozen=True)
class Items:
    """A block of items: for each its terms as numbers and how often it holds them."""

    ids: list
    term: list[np.ndarray]
    times: list[np.ndarray]
    numbers: dict[bytes, int]


def read_items(rows: Iterator) -> Iterator[Items]:
    """Blocks of (id, text) rows within the bounds of a block, or of a single item."""
    ids, term, times, numbers, entries = [], [], [], {}, 0
    for key, text in rows:
        counted = Counter(terms(text))
        more = len(numbers) + len(counted.keys() - numbers.keys())
        if ids and (more > BLOCK_TERMS or entries + len(counted) > BLOCK_ENTRIES):
            yield Items(ids, term, times, numbers)
            ids, term, times, numbers, entries = [], [], [], {}, 0
        ids.append(key)
        term.append(np.array([numbers.setdefault(t, len(numbers)) for t in counted], np.int64))
        times.append(np.array(list(counted.values()), np.int64))
        entries += len(counted)
    if ids:
        yield Items(ids, term, times, numbers)


def postings(docs: DataFrame, numbers: dict[bytes, int], *, key: str, text: str) -> DataFrame:
    """key, n (terms with repeats), and the items' terms it holds with their counts."""
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            sizes, held, often = [], [], []
            for value in batch.column("text").to_pylist():
                found = terms(value)
                counted = [(known[t], c) for t, c in Counter(found).items() if t in known]
                sizes.append(len(found))
                held.append([t for t, _ in counted])
                often.append([c for _, c in counted])
            lists = pa.list_(pa.int32())
            new = [pa.array(sizes, pa.int64()), pa.array(held, lists), pa.array(often, lists)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *new], names=["key", "n", "term", "tf"])

    of_key = plain.schema["key"].dataType.simpleString()
    return plain.mapInArrow(read, f"key {of_key}, n bigint, term array<int>, tf array<int>")


def term_weights(found: DataFrame, n_docs: int, n_numbers: int) -> np.ndarray:
    """The weight of every term number, by the number of documents that hold it."""
    held = found.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = np.zeros(n_numbers, np.int64)
    for row in held.toLocalIterator():
        weights[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
    return weights


class Shard:
    """Impact lists of some documents and every document's position in every list."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int) -> None:
        keep = impact > 0
        doc, term, impact = doc[keep], term[keep], impact[keep]
        order = np.lexsort((-impact, term))
        self.docs, self.impacts, term = doc[order], impact[order], term[order]
        self.sizes = np.bincount(term, minlength=n_terms)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.position = np.full((n_terms, n_docs), ABSENT, np.uint16)
        self.position[term, self.docs] = np.arange(len(term)) - self.starts[term]
        self.n_docs = n_docs

    def search(self, term: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents met and their scores; every document left out scores below the k-th or 0.

        ``floor`` is the k-th best score found before, or 0.
        """
        term, times = term[self.sizes[term] > 0], times[self.sizes[term] > 0]
        starts, sizes = self.starts[term], self.sizes[term]
        # One slot more than a list has, never seen, ends every run.
        offsets = np.cumsum(sizes + 1) - (sizes + 1)
        seen = np.zeros(int((sizes + 1).sum()), bool)
        places = np.arange(len(seen)) - np.repeat(offsets, sizes + 1)
        met = np.zeros(self.n_docs, bool)
        docs, scores = [], []
        depth, step = 0, FIRST_STEP
        kth = floor
        while len(term):
            ahead = np.arange(depth, depth + step)
            inside = ahead < sizes[:, None]
            new = np.unique(self.docs[(starts[:, None] + ahead)[inside]])
            new = new[~met[new]]
            met[new] = True
            position = self.position[np.ix_(term, new)].astype(np.int64)
            listed = position != ABSENT
            seen[(offsets[:, None] + position)[listed]] = True
            value = self.impacts[np.where(listed, starts[:, None] + position, 0)] * listed
            docs.append(new)
            scores.append(times @ value)
            best = np.minimum.reduceat(np.where(seen, len(seen), places), offsets)
            last = self.impacts[starts + np.maximum(best - 1, 0)]
            bound = int((times * last)[best < sizes].sum())
            kth = max(floor, kth_largest(np.concatenate(scores), k))
            if bound < kth or bound == 0:
                break
            depth, step = depth + step, 2 * step
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, score = np.concatenate(docs), np.concatenate(scores)
        good = score >= max(kth, 1)
        return found[good], score[good]


def kth_largest(scores: np.ndarray, k: int) -> int:
    """The k-th largest score; 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Contribution of a term found tf times in a document of n terms."""
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The documents of a task in tables of at most ``limit`` rows."""
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            part = batch.slice(at, limit)
            if rows + part.num_rows > limit:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


class Best:
    """The k best documents of one item: scores falling, equal scores by key, null keys last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows: list[tuple[int, bool, object]] = []

    def add(self, scores: list[int], keys: list) -> None:
        new = [(-s, key is None, 0 if key is None else key) for s, key in zip(scores, keys, strict=True)]
        self.rows = sorted([*self.rows, *new])[: self.k]

    @property
    def floor(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.k else 0


def task_results(
    batches: Iterator[pa.RecordBatch], items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int
) -> list[Best]:
    """The k best documents of every item among the documents of one task."""
    best = [Best(k) for _ in items.ids]
    limit = max(1, min(SHARD_DOCS, SHARD_CELLS // max(1, len(weights))))
    for table in _shards(batches, limit):
        lists = table["term"].combine_chunks()
        doc = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy())
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = table["tf"].combine_chunks().flatten().to_numpy().astype(np.int64)
        length = table["n"].to_numpy()[doc]
        value = impacts(tf, length, weights[term], n_docs, n_terms)
        shard = Shard(doc, term, value, table.num_rows, len(weights))
        keys = table["key"].to_pylist()
        for i, (wanted, times) in enumerate(zip(items.term, items.times, strict=True)):
            found, scores = shard.search(wanted, times, k, best[i].floor)
            best[i].add(scores.tolist(), [keys[d] for d in found.tolist()])
    return best


def search_block(docs: DataFrame, items: Items, *, key: str, text: str, k: int) -> DataFrame:
    """item (its place in the block), key and score: up to k rows an item and task."""
    found = stored(postings(docs, items.numbers, key=key, text=text).where("n > 0"), "postings")
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = term_weights(found, n_docs, len(items.numbers))
    sent = found.sparkSession.sparkContext.broadcast((items, weights))
    of_key = found.schema["key"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known = sent.value
        best = task_results(batches, block, known, n_docs, n_terms, k)
        rows = [(i, None if null else x, -s) for i, b in enumerate(best) for s, null, x in b.rows]
        if rows:
            kinds = (pa.int32(), to_arrow_type(of_key), pa.int64())
            columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "key", "score"])

    plain = found.select("key", "n", "term", "tf")
    return plain.mapInArrow(read, f"item int, key {of_key.simpleString()}, score bigint")


def rank_documents(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = K
) -> DataFrame:
    """The k best documents of every item: item, rank (from 1), key and score.

    ``items`` is the query set, read row by row on the driver; documents never are.
    """
    rows = items.select(F.col(item), F.col(text)).toLocalIterator()
    result = None
    of_item = items.schema[item].dataType.simpleString()
    spark = docs.sparkSession
    for number, block in enumerate(read_items((r[0], r[1]) for r in rows)):
        found = search_block(docs, block, key=key, text=text, k=k).withColumn("block", F.lit(number))
        ids = spark.createDataFrame(list(enumerate(block.ids)), f"item int, id {of_item}")
        in_order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
        ranked = found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
        named = ranked.join(F.broadcast(ids), "item").select(
            F.col("id").alias(item), "rank", F.col("key").alias(key), "score"
        )
        result = named if result is None else result.unionByName(named)
    if result is None:
        of_key = docs.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"`{item}` {of_item}, rank int, `{key}` {of_key}, score bigint")
    return result


ship(__name__)
