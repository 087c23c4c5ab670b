"""Alignment of two tokenizers by the byte offsets where tokens of both end.

Tokenizer A (byte-level BPE) encodes a space and the text; tokenizer B (pieces with byte
fallback, ``sentencepiece``) encodes the text and adds the space itself. Special strings
in a text are plain text. A's file is read whole; where its merges are in the order of
their ids, as in the given file, ``tiktoken`` runs them, which is seven times as fast as
``tokenizers`` and gives the same ids (tested); texts from ``LONG_TEXT`` on and any other
file go through ``tokenizers``. Each id list is turned into a
dictionary from cumulative byte end to the index behind the last token ending there;
the sorted common keys slice both lists into groups. The tokens that end at a common
end are linked, all of A's with all of B's: a token has one byte or more, so this is
the last token of both slices.

How often an id pair is linked over the corpus is counted from the pairs that each
document holds, already summed per document. Counts meet the documents' pairs by a
broadcast as long as the counted pairs stay within ``BROADCAST_ROWS``, else by a shuffle
under a salt. Encoded documents are stored once, without their texts.

Defined cases: a null or empty text, or one that a tokenizer does not give back byte for
byte, has no tokens: zeros and an empty digest; repeated rows are documents of their own
and count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveatlas.llm.text import BROADCAST_ROWS, ship, stored

FILES = "/opt/tokenizers"
FILE_A = "byte_bpe_50k.json"
FILE_B = "piece_bpe_32k.model"
SALTS = 32
#: Code points from which on a text is left to ``tokenizers``.
LONG_TEXT = 100_000

# The pre-tokenizer that ``PATTERN`` stands for, and how it splits a text
# into words.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary(NamedTuple):
    """Every id's bytes, number of bytes, and its decimal text with what follows it.

    ``written`` holds ``id,`` at twice the id and ``id`` with the closing sign behind it.
    """

    parts: list[bytes]
    sizes: np.ndarray
    written: list[str]


def vocabulary(parts: list[bytes], close: str) -> Vocabulary:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return Vocabulary(parts, sizes, [f"{i}{sign}" for i in range(len(parts)) for sign in (",", close)])


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, as letter to byte.

    Visible Latin-1 characters stand for themselves, the other bytes for the code points
    from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def piece_bytes(piece: str) -> bytes:
    """A piece's bytes: ``<0xHH>`` is one byte, U+2581 a space."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode("utf-8")


class Pair:
    """Both tokenizers, loaded once in a Python worker."""

    def __init__(self, folder: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{FILE_A}")
        self.a.encode_special_tokens = True
        letters = byte_letters()
        words = self.a.get_vocab(with_added_tokens=True)
        parts = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            whole = all(c in letters for c in word)
            parts[i] = bytes(letters[c] for c in word) if whole else word.encode("utf-8")
        self.of_a = vocabulary(parts, "|")
        self.fast = fast_tokenizer(f"{folder}/{FILE_A}", parts)
        self.b = SentencePieceProcessor(model_file=f"{folder}/{FILE_B}")
        pieces = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.of_b = vocabulary(pieces, ";")
        self.written = self.of_a.written + self.of_b.written

    def ids_a(self, text: str) -> list[int]:
        if self.fast is None or len(text) >= LONG_TEXT:
            return self.a.encode(f" {text}", add_special_tokens=False).ids
        return self.fast.encode_ordinary(f" {text}")

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none where a tokenizer does not give back the bytes."""
        if not text:
            return NO_IDS, NO_IDS
        whole = f" {text}".encode()
        ids_a, ids_b = self.ids_a(text), self.b.encode(text, num_threads=1)
        for known, ids in ((self.of_a, ids_a), (self.of_b, ids_b)):
            if b"".join(map(known.parts.__getitem__, ids)) != whole:
                return NO_IDS, NO_IDS
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64)

    def cut(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return slices(self.of_a.sizes[ids_a], self.of_b.sizes[ids_b])


NO_IDS = np.zeros(0, np.int64)


def fast_tokenizer(path: str, parts: list[bytes]):
    """The file's BPE in ``tiktoken``; None where merges are not in the order of their ids."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    plain = content["pre_tokenizer"] == BYTE_LEVEL and content["normalizer"] is None and not model["ignore_merges"]
    if not plain or any(vocab[x + y] != 256 + i for i, (x, y) in enumerate(pairs)):
        return None
    special = {added["id"] for added in content["added_tokens"]}
    ranks = {part: i for i, part in enumerate(parts) if i not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def tokenizers_of(folder: str) -> Pair:
    return Pair(folder)


def end_index(sizes: np.ndarray, last: int) -> np.ndarray:
    """From every cumulative byte end to the index behind the last token that ends there, else 0.

    Ends are small numbers, so the dictionary is addressed by the end itself.
    """
    index = np.zeros(last + 1, np.int64)
    index[np.cumsum(sizes)] = np.arange(1, len(sizes) + 1)
    return index


def slices(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices behind every group in A and in B, at the keys of both dictionaries in order."""
    last = int(max(sizes_a.sum(), sizes_b.sum()))
    by_a, by_b = end_index(sizes_a, last), end_index(sizes_b, last)
    common = np.flatnonzero((by_a > 0) & (by_b > 0))
    return by_a[common], by_b[common]


def groups_text(pair: Pair, ids_a: np.ndarray, ids_b: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> str:
    """``a1,a2|b1;a3|b2,b3``: every group's tokens of A, then of B, each with what follows it."""
    cuts_a, cuts_b = cuts
    before_a, before_b = np.concatenate([[0], cuts_a[:-1]]), np.concatenate([[0], cuts_b[:-1]])
    code_a, code_b = 2 * ids_a, 2 * (ids_b + len(pair.of_a.parts))
    code_a[cuts_a - 1] += 1
    code_b[cuts_b - 1] += 1
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.repeat(before_b, cuts_a - before_a)] = code_a
    order[np.arange(len(ids_b)) + np.repeat(cuts_a, cuts_b - before_b)] = code_b
    return "".join(map(pair.written.__getitem__, order.tolist()))[:-1]


def groups_digest(pair: Pair, ids_a: np.ndarray, ids_b: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> str:
    """SHA-256 of the groups as text; empty without tokens."""
    return hashlib.sha256(groups_text(pair, ids_a, ids_b, cuts).encode("ascii")).hexdigest() if len(ids_a) else ""


def linked_pairs(ids_a: np.ndarray, ids_b: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One code per link: A's id in the upper 32 bits, B's below."""
    return (ids_a[cuts[0] - 1] << 32) | ids_b[cuts[1] - 1]


ENCODED = {
    "n_a": ("bigint", pa.int64()),
    "n_b": ("bigint", pa.int64()),
    "n_groups": ("bigint", pa.int64()),
    "n_links": ("bigint", pa.int64()),
    "groups_sha256": ("string", pa.string()),
    "codes": ("array<bigint>", pa.list_(pa.int64())),
    "times": ("array<int>", pa.list_(pa.int32())),
}


def encoded_row(pair: Pair, text: str | None) -> tuple:
    """A document's values of ``ENCODED``."""
    ids_a, ids_b = pair.encode(text)
    if not len(ids_a):
        return 0, 0, 0, 0, "", [], []
    cuts = pair.cut(ids_a, ids_b)
    codes, times = np.unique(linked_pairs(ids_a, ids_b, cuts), return_counts=True)
    n = len(cuts[0])
    return len(ids_a), len(ids_b), n, n, groups_digest(pair, ids_a, ids_b, cuts), codes, times.astype(np.int32)


def encode(docs: DataFrame, *, key: str, text: str, folder: str) -> DataFrame:
    """One row per document: row, key, counts, digest and its distinct links with their number."""
    plain = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")
    )
    of_key = plain.schema["key"].dataType.simpleString()
    kinds = ", ".join(f"{name} {kind}" for name, (kind, _) in ENCODED.items())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers_of(folder)
        for batch in batches:
            rows = [encoded_row(pair, t) for t in batch.column("text").to_pylist()]
            if rows:
                new = [pa.array(v, t) for v, (_, t) in zip(zip(*rows, strict=True), ENCODED.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("key"), *new], names=["row", "key", *ENCODED]
                )

    return plain.mapInArrow(read, f"row bigint, key {of_key}, {kinds}")


def single_links(encoded: DataFrame) -> DataFrame:
    """row, code, times: the distinct links of every document."""
    zipped = F.explode(F.arrays_zip("codes", "times")).alias("link")
    return encoded.select("row", zipped).select("row", "link.codes", "link.times").toDF("row", "code", "times")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """Every linked id pair: code, its links over the corpus, whether no pair of its B id has more."""
    links = single_links(encoded).groupBy("code").agg(F.sum("times").alias("links"))
    to_b = F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))
    links = links.withColumn("b", to_b)
    top = links.groupBy("b").agg(F.max("links").alias("top"))
    return links.join(top, "b").select("code", "links", (F.col("links") == F.col("top")).alias("best"))


def align(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    folder: str = FILES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document: key, counts of tokens, groups and links, digest, link scores.

    ``n_best`` are the links whose pair is linked most often among its B id's pairs,
    ``count_sum`` adds up the corpus-wide counts of the document's links.
    """
    encoded = stored(encode(docs, key=key, text=text, folder=folder), "encoded")
    counts = stored(pair_counts(encoded), "pair-counts")
    links = single_links(encoded)
    if counts.count() <= broadcast_rows:
        met = links.join(F.broadcast(counts), "code")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salted = links.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        met = salted.join(counts.select("*", salt), ["code", "salt"])
    scores = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("links")).cast("long").alias("count_sum"),
    )
    joined = encoded.drop("codes", "times").join(scores, "row", "left").fillna(0, ["n_best", "count_sum"])
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return joined.select(F.col("key").alias(key), *names)


ship(__name__)
