r"""Suffix dedup: repeated 50-byte strings by bucket-pointer refinement.

A byte is removed if a 50-byte string covers it that also starts in a document with a
smaller id. Strings are suffixes cut at 50 bytes, and they are ordered into buckets the
way bucket-pointer refinement does: the identifier of a longer prefix is the pair of two
identifiers already known, of the prefix and of a later offset (1, 2, 4, 8, 16, 20 bytes;
then 32 and 50), so every refinement reuses the last.

Not every suffix is sent out. Each 50-byte string belongs to the bucket of the smallest
20-byte identifier in it, so equal strings meet in one bucket wherever they stand, and
neighbouring strings of one bucket travel as one run:

1. Runs are sorted by bucket and content within each partition and read as a stream. A
   run whose whole content was seen in a smaller document is removed. Copies within one
   batch are settled before the shuffle: a passage that a third of all documents hold
   leaves each batch once.
2. Where a bucket holds runs of different content that agree on one side of the bucket
   string, as runs that share a string must (or hold theirs twice), the first run of each content is refined to its single 50-byte strings: the bytes of these runs are sent to their
   bucket's partition and sorted there by the full identifiers (128 bits), whole buckets in
   memory and the strings of very large ones by Spark; the smallest document of each string
   keeps it.

Documents meet their removed intervals by id, and the remaining bytes are joined.

Defined cases: a null text is empty; texts under 50 bytes lose nothing; a document
without an id neither loses nor causes a removal; rows of one id are taken as copies of
one document and do not remove each other; text is UTF-8, and cuts may split a character.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moveatlas.llm.text import ship, stored

LENGTH = 50
GRAM = 20
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SIDE = (LENGTH - GRAM) // 2
SLICE_BYTES = 2_000_000
#: Documents that a task works on at a time.
ROWS = 500
#: Strings of one bucket up to which they are settled in memory.
BUCKET_STRINGS = 2_000_000
RUN, REMOVED, TWICE = 0, 1, 2
CHUNKS = "part int, rows binary"
RUNS = "bucket int, content long, doc long, start int, stop int, left short, right short, kind byte"
SPANS = "bucket int, doc long, start int, stop int, left short, right short, kind byte"
PACKED = "doc long, packed binary"
PIECES = "bucket int, doc long, start int, piece binary"
STRINGS = "a long, b long, doc long, start int, stop int, kind byte"
LATER = "doc long, start int, stop int"


def refine(buckets: np.ndarray, offset: int, odd: np.uint64) -> np.ndarray:
    """Identifiers of longer prefixes from those at ``offset`` bytes further on."""
    head = buckets[:-offset]
    return ((head ^ (head >> np.uint64(29))) * odd) + buckets[offset:] * (odd >> np.uint64(7) | np.uint64(1))


def grams(raw: np.ndarray, odd: np.uint64) -> np.ndarray:
    """Identifiers of all 16-byte strings."""
    buckets = (raw.astype(np.uint64) + np.uint64(1)) * odd
    for offset in (1, 2, 4, 8):
        buckets = refine(buckets, offset, odd)
    return buckets


def scattered(buckets: np.ndarray) -> np.ndarray:
    """Identifiers with well-mixed high bits, for choosing the smallest."""
    mixed = (buckets ^ (buckets >> np.uint64(31))) * ODD[1]
    return (mixed ^ (mixed >> np.uint64(33))) * ODD[0]


def runs(raw: bytes) -> tuple[np.ndarray, ...]:
    """Bucket, first and last start, left and right side, kind of every run of 50-byte strings.

    All strings of a run hold one place of its 20-byte bucket string. What two runs share
    holds 15 more bytes left or right of that place; a side is the 16-byte identifier
    there cut to 1..30000, and 0 if no string of the run reaches that far. A string that
    holds its bucket string more than once can have another place in another run, so
    runs with such a string are of kind TWICE and need not agree on a side.
    """
    if len(raw) < LENGTH:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, none
    by_16 = grams(np.frombuffer(raw, np.uint8), ODD[0])
    buckets = scattered(refine(by_16, GRAM - 16, ODD[0]))
    width, low = LENGTH - GRAM + 1, buckets
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.append(first[1:], len(low)) - 1
    done = []
    while len(first):
        same = buckets[first[:, None] + np.arange(width)] == low[first][:, None]
        place = first + width - 1 - np.argmax(same[:, ::-1], axis=1)
        end = np.minimum(last, place)
        done.append((first, end, place))
        longer = last > place
        first, last = place[longer] + 1, last[longer]
    first, last, place = (np.concatenate(x) for x in zip(*done, strict=True))
    sides = (scattered(by_16) % np.uint64(30000)).astype(np.int64) + 1
    left = np.where(place - first >= SIDE, sides[np.maximum(place - SIDE, 0)], 0)
    reach = last + LENGTH - place - GRAM >= SIDE
    right = np.where(reach, sides[np.minimum(place + GRAM - 1, len(sides) - 1)], 0)
    before, after = equal_neighbours(buckets, low, width)
    twice = (before[place] >= first) | (after[place] < last + width)
    kind = np.where(twice, TWICE, RUN)
    return low[first], first, last, left, right, kind


def equal_neighbours(buckets: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place that is the least of a window: the nearest place of the same value
    before it (else -1) and after it (else one beyond all) that is the least of a window.

    A place is the least of a window if the largest of the minima of its windows is its
    own value; only these places, one in sixteen, are sorted.
    """
    most = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    size = 1
    while size * 2 <= width:
        most = np.maximum(most[:-size], most[size:])
        size *= 2
    most = np.maximum(most[: len(most) - (width - size)], most[width - size :])
    least = np.flatnonzero(buckets == most)
    order = least[np.argsort(buckets[least], kind="stable")]
    before, after = np.full(len(buckets), -1), np.full(len(buckets), len(buckets))
    same = buckets[order[1:]] == buckets[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def strings(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two identifiers of every 50-byte string."""
    found = []
    for odd in ODD:
        by_16 = grams(np.frombuffer(raw, np.uint8), odd)
        found.append(refine(refine(by_16, 16, odd), LENGTH - 32, odd))
    return found[0], found[1]


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; touching ones become one."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]


def settled_here(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pd.DataFrame:
    """REMOVED intervals, united within each document."""
    found, group = np.unique(doc, return_inverse=True)
    shift = group.astype(np.int64) << 33
    start, stop = merged(start + shift, stop + shift)
    group = start >> 33
    shift = group << 33
    return pd.DataFrame(
        {
            "doc": found[group].astype(np.int64), "start": (start - shift).astype(np.int32),
            "stop": (stop - shift).astype(np.int32), "kind": np.int8(REMOVED),
        }
    )


def spread(rows: pd.DataFrame) -> np.ndarray:
    """Numbers that deal settled rows evenly over partitions."""
    return ((rows["doc"].to_numpy() * 40503 + rows["start"].to_numpy()) % (1 << 30)).astype(np.int64)


def slices(column: pa.Array) -> Iterator[tuple[range, list[bytes]]]:
    """Index ranges of about ``SLICE_BYTES`` each, with their texts."""
    texts: list[bytes] = []
    begin = size = 0
    for i, text in enumerate(column):
        texts.append(utf8(text))
        size += len(texts[-1])
        if size >= SLICE_BYTES or i == len(column) - 1:
            yield range(begin, i + 1), texts
            begin, size, texts = i + 1, 0, []


def utf8(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


FIELDS = {
    "bucket": np.uint32, "content": np.uint64, "doc": np.int64, "start": np.int32, "stop": np.int32,
    "left": np.int16, "right": np.int16, "kind": np.int8,
}
Rows = dict[str, np.ndarray]


def chunk(rows: Rows) -> bytes:
    """Rows of ``FIELDS`` column by column, documents as a list and an index."""
    docs, at = np.unique(rows["doc"], return_inverse=True)
    head = np.array([len(at), len(docs)], "<i4")
    length = rows["stop"] - rows["start"]
    long = np.flatnonzero(length > 255)
    parts = [
        head, np.array([len(long)], "<i4"), docs, at.astype("<i4" if len(docs) > 65535 else "<u2"), rows["bucket"],
        rows["content"], rows["start"], np.minimum(length, 255).astype("u1"), long.astype("<i4"),
        length[long].astype("<i4"), rows["left"], rows["right"], rows["kind"],
    ]
    return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


def unchunk(raw: bytes) -> pa.RecordBatch:
    """A chunk as rows."""
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, kind, n, at)
        at += found.nbytes
        return found

    n, n_docs = take("<i4", 2)
    (n_long,) = take("<i4", 1)
    docs = take("<i8", n_docs)
    doc = docs[take("<i4" if n_docs > 65535 else "<u2", n)]
    bucket, content, start = take("<u4", n), take("<u8", n), take("<i4", n)
    length = take("u1", n).astype(np.int32)
    long = take("<i4", n_long)
    length[long] = take("<i4", n_long)
    left, right, kind = take("<i2", n), take("<i2", n), take("i1", n)
    return pa.record_batch(
        {
            "bucket": pa.array(bucket.view(np.int32)), "content": pa.array(content.view(np.int64)), "doc": pa.array(doc),
            "start": pa.array(start), "stop": pa.array(start + length), "left": pa.array(left),
            "right": pa.array(right), "kind": pa.array(kind),
        }
    )


def slice_runs(docs: list[int], texts: list[bytes]) -> Rows:
    """Runs of some documents; of equal runs only those of the smallest document, the
    others as settled intervals."""
    parts = [runs(raw) for raw in texts]
    bucket, first, last, left, right, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
    sizes = [len(x[0]) for x in parts]
    content = np.empty(len(bucket), np.uint64)
    digest, at, begins, ends = xxhash.xxh64_intdigest, 0, first.tolist(), (last + LENGTH).tolist()
    for raw, n in zip(texts, sizes, strict=True):
        content[at : at + n] = [digest(raw[a:b]) for a, b in zip(begins[at : at + n], ends[at : at + n], strict=True)]
        at += n
    rows = {
        "bucket": (bucket >> np.uint64(32)).astype(np.uint32), "content": content,
        "doc": np.repeat(np.array(docs, np.int64), sizes), "start": first.astype(np.int32),
        "stop": (last + LENGTH).astype(np.int32), "left": left.astype(np.int16), "right": right.astype(np.int16),
        "kind": kind.astype(np.int8),
    }
    order = np.lexsort((rows["doc"], content))
    rows = {k: v[order] for k, v in rows.items()}
    content, doc = rows["content"], rows["doc"]
    new = np.concatenate([[True], content[1:] != content[:-1]])[: len(content)]
    own = doc == doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = settled_here(doc[~own], rows["start"][~own], rows["stop"][~own])
    settled = {k: np.zeros(len(gone), of) for k, of in FIELDS.items()}
    for name in ("doc", "start", "stop", "kind"):
        settled[name] = gone[name].to_numpy()
    settled["bucket"] = spread(gone).astype(np.uint32)
    return {k: np.concatenate([rows[k][own], settled[k]]).astype(of) for k, of in FIELDS.items()}


def run_sender(n_parts: int):
    """A task that sends runs as one chunk for each part of a slice of documents."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_pylist()
            for some, texts in slices(batch.column("text")):
                rows = slice_runs(docs[some.start : some.stop], texts)
                part = rows["bucket"] % n_parts
                order = np.argsort(part, kind="stable")
                rows, part = {k: v[order] for k, v in rows.items()}, part[order]
                new = np.concatenate([[True], part[1:] != part[:-1]])[: len(part)]
                at = np.flatnonzero(new)
                ends = np.append(at[1:], len(part))
                packed = [
                    chunk({k: v[a:b] for k, v in rows.items()}) for a, b in zip(at.tolist(), ends.tolist(), strict=False)
                ] if len(part) else []
                yield pa.record_batch(
                    {"part": pa.array(part[at].astype(np.int32)), "rows": pa.array(packed, pa.binary())}
                )

    return send


def open_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks as rows again."""
    for batch in batches:
        for raw in batch.column("rows"):
            yield unchunk(raw.as_buffer().to_pybytes())


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the way to their intervals."""
    for batch in batches:
        packed = [zlib.compress(utf8(t), 1) for t in batch.column("text")]
        yield pa.record_batch({"doc": batch.column("doc"), "packed": pa.array(packed, pa.binary())})


def read_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sorted partition of runs to REMOVED intervals and runs of several contents.

    Keeps the content being read, its smallest document, and the runs of the first
    content of the bucket until a second content is read.
    """
    bucket = content = doc = None
    second = False
    waiting: pd.DataFrame | None = None
    for batch in batches:
        gone = batch["kind"] == REMOVED
        if gone.any():
            yield batch.loc[gone, ["bucket", "doc", "start", "stop", "left", "right", "kind"]]
            batch = batch[~gone]
        b, c, d = (batch[k].to_numpy() for k in ("bucket", "content", "doc"))
        if not len(b):
            continue
        new_b = np.concatenate([[bucket is None or b[0] != bucket], b[1:] != b[:-1]])
        new_c = new_b | np.concatenate([[content is None or c[0] != content], c[1:] != c[:-1]])
        group = np.cumsum(new_c)
        owners = np.concatenate([[doc if doc is not None else 0], d[new_c]])
        own = d == owners[group]
        place = np.cumsum(new_b)
        #: Contents read of each bucket in this batch; the one carried on may have had more.
        contents = np.bincount(place, weights=new_c, minlength=place[-1] + 1)
        if not new_b[0]:
            contents[0] += 2 if second else 1
        several = contents[place] > 1
        if waiting is not None:
            if not new_b[0] and contents[0] > 1:
                yield waiting
                waiting = None
            elif place[-1] > 0:
                waiting = None
        out = batch[["bucket", "doc", "start", "stop", "left", "right"]].assign(kind=np.where(own, batch["kind"], REMOVED).astype(np.int8))
        yield out[~own | several]
        last = place == place[-1]
        if not several[-1]:
            held = out[own & last]
            waiting = held if waiting is None or new_b[last].any() else pd.concat([waiting, held])
        second = bool(several[-1])
        bucket, content, doc = b[-1], c[-1], owners[group[-1]]


def lists(column: pa.ListArray) -> Iterator[dict[str, np.ndarray]]:
    """The structs of each row's list as arrays by field; empty for null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values
    fields = {f.name: values.field(f.name).to_numpy() for f in values.type}
    for valid, a, b in zip(column.is_valid().to_pylist(), offsets[:-1], offsets[1:], strict=True):
        yield {k: v[a : b if valid else a] for k, v in fields.items()}


def open_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of open runs (columns doc, packed, runs)."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            doc, bucket, start, piece = [], [], [], []
            packed = batch.column("packed")
            for i, found in enumerate(lists(batch.column("runs"))):
                raw = zlib.decompress(packed[i].as_buffer())
                doc.append(np.full(len(found["start"]), batch.column("doc")[i].as_py(), np.int64))
                bucket.append(found["bucket"])
                start.append(found["start"])
                piece += [raw[a:b] for a, b in zip(found["start"].tolist(), found["stop"].tolist(), strict=True)]
            yield pa.record_batch(
                {
                    "bucket": pa.array(np.concatenate(bucket)), "doc": pa.array(np.concatenate(doc)),
                    "start": pa.array(np.concatenate(start)), "piece": pa.array(piece, pa.binary()),
                }
            )


Strings = dict[str, np.ndarray]


def batch_strings(batch: pd.DataFrame) -> Strings:
    """bucket, both identifiers, doc and start of every 50-byte string of the pieces."""
    sizes = batch["piece"].map(len).to_numpy()
    counts = np.maximum(sizes - LENGTH + 1, 0)
    total = int(counts.sum())
    a, b = strings(b"".join(batch["piece"])) if total else (np.zeros(0, np.uint64),) * 2
    within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(sizes) - sizes, counts) + within
    found = {name: np.repeat(batch[name].to_numpy(), counts) for name in ("bucket", "doc", "start")}
    return {**found, "start": (found["start"] + within).astype(np.int32), "a": a[at], "b": b[at]}


def open_strings(found: Strings) -> pd.DataFrame:
    """Strings that are still to be sorted."""
    return pd.DataFrame(
        {
            "a": found["a"].view(np.int64), "b": found["b"].view(np.int64), "doc": found["doc"], "start": found["start"],
            "stop": found["start"] + LENGTH, "kind": np.int8(RUN),
        }
    )


def settled_strings(found: Strings) -> pd.DataFrame:
    """Strings of whole buckets to the intervals of those that a smaller document has."""
    order = np.lexsort((found["doc"], found["b"], found["a"]))
    a, b, d = (found[k][order] for k in ("a", "b", "doc"))
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    later = d > d[new][np.cumsum(new) - 1]
    start = found["start"][order][later]
    gone = settled_here(d[later], start, start + LENGTH)
    code = spread(gone)
    return gone.assign(a=code, b=code)[["a", "b", "doc", "start", "stop", "kind"]]


def piece_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces by bucket to settled intervals.

    Whole buckets are settled here, the last one when its end is read. Strings of a
    bucket that holds over ``BUCKET_STRINGS`` go on unsettled, to be sorted.
    """
    tail: Strings | None = None
    large = None
    for batch in batches:
        found = batch_strings(batch)
        if tail is not None:
            found = {k: np.concatenate([tail[k], v]) for k, v in found.items()}
            tail = None
        bucket = found["bucket"]
        if not len(bucket):
            continue
        begin = int(np.searchsorted(bucket, large, side="right")) if large is not None else 0
        if begin:
            yield open_strings({k: v[:begin] for k, v in found.items()})
        end = max(begin, int(np.searchsorted(bucket, bucket[-1])))
        if end > begin:
            yield settled_strings({k: v[begin:end] for k, v in found.items()})
        tail = {k: v[end:] for k, v in found.items()}
        if len(tail["a"]) > BUCKET_STRINGS:
            large = tail["bucket"][-1]
            yield open_strings(tail)
            tail = None
    if tail is not None and len(tail["a"]):
        yield settled_strings(tail)


def read_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted strings to the intervals of those that a smaller document has; settled ones pass."""
    a = b = doc = None
    for batch in batches:
        gone = batch["kind"] == REMOVED
        if gone.any():
            yield batch.loc[gone, ["doc", "start", "stop"]]
            batch = batch[~gone]
        x, y, d = (batch[k].to_numpy() for k in ("a", "b", "doc"))
        if not len(x):
            continue
        new = np.concatenate([[a is None or x[0] != a or y[0] != b], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        owners = np.concatenate([[doc if doc is not None else 0], d[new]])[np.cumsum(new)]
        later = d > owners
        start = batch["start"].to_numpy()[later]
        gone = settled_here(d[later], start, start + LENGTH)
        yield gone[["doc", "start", "stop"]]
        a, b, doc = x[-1], y[-1], owners[-1]


def document_cutter(with_kept: bool):
    """A task from documents (doc_id, packed, spans) to counts, digest and kept bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                packed, rows = batch.column("packed"), []
                for i, found in enumerate(lists(batch.column("spans"))):
                    raw = zlib.decompress(packed[i].as_buffer())
                    start, stop = merged(found["start"].astype(np.int64), found["stop"].astype(np.int64))
                    stop = np.minimum(stop, len(raw))
                    edges = np.concatenate([[0], np.ravel(np.column_stack([start, stop])), [len(raw)]]).astype(int)
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
                    digest = hashlib.sha256(kept).hexdigest()
                    rows.append((len(raw), int((stop - start).sum()), len(start), digest, kept if with_kept else None))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names)

    return cut


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def by_document(spans: DataFrame, name: str, *fields: str) -> DataFrame:
    """One row per document with its list of intervals."""
    return spans.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct(*fields)).alias(name))


def open_runs(several: DataFrame, n: int) -> DataFrame:
    """Runs with another of their bucket that agrees on a side, or both of kind TWICE."""
    runs = several.where(F.col("kind") != REMOVED).repartition(n, "bucket")
    for side in ("left", "right"):
        same = F.count("*").over(Window.partitionBy("bucket", side))
        runs = runs.withColumn(f"n_{side}", F.when(F.col(side) > 0, same).otherwise(0))
    same = F.count("*").over(Window.partitionBy("bucket", "kind"))
    runs = runs.withColumn("n_twice", F.when(F.col("kind") == TWICE, same).otherwise(0))
    return runs.where((F.col("n_left") > 1) | (F.col("n_right") > 1) | (F.col("n_twice") > 1))


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc, start, stop: the removed byte intervals of documents (doc, text; no null doc)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.mapInArrow(run_sender(n), CHUNKS).repartitionById(n, F.col("part"))
    ordered = sent.mapInArrow(open_chunks, RUNS).sortWithinPartitions("bucket", "content", "doc")
    several = stored(ordered.mapInPandas(read_runs, SPANS), "runs")
    still = by_document(open_runs(several, n), "runs", "bucket", "start", "stop")
    met = docs.mapInArrow(pack, PACKED).join(still, F.col("doc") == F.col("of")).select("doc", "packed", "runs")
    #: Equal strings have one bucket, so they are together before and after they are sorted.
    pieces = met.mapInArrow(open_pieces, PIECES).repartition(n, "bucket").sortWithinPartitions("bucket")
    ids = pieces.mapInPandas(piece_strings, STRINGS).sortWithinPartitions("a", "b", "doc")
    later = ids.mapInPandas(read_strings, LATER)
    whole = several.where(F.col("kind") == REMOVED).select("doc", "start", "stop")
    return whole.unionByName(later)


def cut_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    spans = by_document(removed_spans(rows.where(F.col("doc").isNotNull())), "spans", "start", "stop")
    packed = rows.mapInArrow(pack, PACKED)
    met = packed.join(spans, F.col("doc") == F.col("of"), "left")
    return met.select(F.col("doc").alias("doc_id"), "packed", "spans").mapInArrow(document_cutter(with_kept), CUT)


ship(__name__)
