r"""Secrets in texts, told from copied examples by corpus-wide ownership.

Base kinds, leftmost matches per kind that do not overlap, over code points:

* ``assign``: a keyword, ``:`` or ``=``, and a value of 6 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 20 or more characters;
* ``hex``: 24 or more lower-case hexadecimal digits.

Wider kinds, where no base match lies: ``pem`` (private key block), ``jwt``, ``vendor``
(published token prefixes), ``url`` (user and password) and ``blob`` (a random-looking
run of 24 or more letters and digits).

Ownership: every candidate's value is hashed and counted over the corpus by distinct
repositories and distinct owners. A value of ``MIN_OWNERS`` or more owners is a copied
example; any other value is ``live`` if it looks random (a key block always does) and
``plain`` if not. Base
matches are always reported, a wider match only if its value is live.

Counting removes repeats by (value, owner, repository) first, so a value that stands in
a third of all documents is spread over tasks, and the verdicts meet the candidates
under a salt. Texts do not move; documents without candidates move nowhere.

Defined cases: a null text is empty; a null owner or repository is one owner or
repository of its own; repeated rows are documents that share their repository; an
empty table gives an empty result; columns of any other name are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas.llm.text import ship, stored

#: Distinct owners from which on a value is a copied example.
MIN_OWNERS = 3
#: Bits per character, and changes of character class per character, of random values.
MIN_BITS = 3.0
MIN_CHANGES = 0.25
SALTS = 16

BASE_KINDS = ("assign", "access", "hex")
WIDER_KINDS = ("pem", "jwt", "vendor", "url", "blob")
KINDS = (*BASE_KINDS, *WIDER_KINDS)

# The patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Every wider pattern starts at a literal or at the start of a run, so reading is linear.
WIDER = {
    "pem": re.compile(
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
    ),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "vendor": re.compile(
        r"(?<![A-Za-z0-9_-])(?:gh[opsru]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|sk_live_[A-Za-z0-9]{24,99}"
        r"|xox[abprs]-[A-Za-z0-9-]{10,99}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])"
    ),
    "url": re.compile(r"://[^\s/:@]+:[^\s/:@]+@"),
    "blob": re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}"),
}
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|redacted|your|x{4,}|\*{3,}|(.)\1{5,}", re.I)

Found = tuple[str, int, int, str]


def base_matches(text: str) -> list[Found]:
    """(kind, start, end, value) of the base kinds."""
    found = [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]


def wider_matches(text: str, taken: list[Found]) -> list[Found]:
    """Matches of the wider kinds that overlap neither ``taken`` nor each other."""
    found: list[Found] = []
    busy = sorted((a, b) for _, a, b, _ in taken)
    for kind, pattern in WIDER.items():
        new, i, reach = [], 0, -1
        for m in pattern.finditer(text):
            a, b = m.span()
            while i < len(busy) and busy[i][0] < b:
                reach = max(reach, busy[i][1])
                i += 1
            if reach > a or (kind == "blob" and not looks_random(m[0])):
                continue
            new.append((kind, a, b, "".join(m[0].split())))
        if new:
            found += new
            busy = sorted([*busy, *((a, b) for _, a, b, _ in new)])
    return found


def _char_class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2


def looks_random(value: str) -> bool:
    """Whether a value looks drawn at random: varied characters, no placeholder, and digits,
    small and capital letters that alternate often."""
    if len(value) < 6 or PLACEHOLDER.search(value):
        return False
    size = len(value)
    bits = -sum(n / size * math.log2(n / size) for n in Counter(value).values())
    classes = [_char_class(c) for c in value if c.isalnum()]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    return bits >= min(MIN_BITS, 0.8 * math.log2(size)) and changes >= MIN_CHANGES * (size - 1)


def _code(value: str) -> bytes:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def candidates(text: str) -> list[tuple[str, int, int, bytes, bool]]:
    """(kind, start, end, value's hash, looks random) of a text, in the order of spans."""
    base = base_matches(text)
    found = base + wider_matches(text, base)
    order = {kind: i for i, kind in enumerate(KINDS)}
    found.sort(key=lambda f: (f[1], order[f[0]]))
    return [(kind, a, b, _code(value), kind == "pem" or looks_random(value)) for kind, a, b, value in found]


SPAN_FIELDS = ("kind", "start", "stop", "code", "random")
SPANS = pa.list_(
    pa.struct(zip(SPAN_FIELDS, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True))
)


def scan(docs: DataFrame, *, key: str, text: str, repository: str, owner: str) -> DataFrame:
    """One row per document: row, key, owner, repository and the candidate spans; no text."""
    plain = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"),
        F.col(text).alias("text"),
    )
    rest = ["row", "key", "repository", "owner"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.select(*rest).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidates(t or "") for t in batch.column("text").to_pylist()]
            spans = pa.array([[dict(zip(SPAN_FIELDS, c, strict=True)) for c in f] for f in found], SPANS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), spans], names=[*rest, "spans"])

    span = "struct<kind:string,start:bigint,stop:bigint,code:binary,random:boolean>"
    return plain.mapInArrow(read, f"{schema}, spans array<{span}>")


def ownership(scanned: DataFrame) -> DataFrame:
    """Every candidate value's number of distinct repositories and owners."""
    held = scanned.select(F.explode("spans.code").alias("code"), "owner", "repository").distinct()
    by_owner = held.groupBy("code", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("code").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def judged(scanned: DataFrame, min_owners: int) -> DataFrame:
    """Per document with candidates: row, its spans each with a ``verdict``."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    verdicts = ownership(scanned).select(
        F.col("code").alias("__code"), (F.col("owners") >= min_owners).alias("copied"), salts.alias("__salt")
    )
    single = scanned.select("row", F.explode("spans").alias("span")).withColumn(
        "salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    )
    met = single.join(verdicts, (F.col("span.code") == F.col("__code")) & (F.col("salt") == F.col("__salt")))
    verdict = F.when(F.col("copied"), "copied").when(F.col("span.random"), "live").otherwise("plain")
    spans = F.collect_list(F.struct("span.start", _rank("span.kind"), "span.kind", "span.stop", verdict.alias("verdict")))
    return met.groupBy("row").agg(F.array_sort(spans).alias("found"))


def _rank(kind: str) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col(kind)).alias("rank")


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    return F.array_join(shown, ",")


def find_secrets(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    min_owners: int = MIN_OWNERS,
) -> DataFrame:
    """One row per document: the key, ``found`` and counts.

    ``found`` lists the reported spans by start with kind, start, stop and verdict
    (``live``, ``copied`` or ``plain``): all base matches and the live wider ones.
    ``n_live`` and ``n_copied`` count the verdicts of all reported base and wider spans.
    """
    scanned = stored(scan(docs, key=key, text=text, repository=repository, owner=owner), "secret-candidates")
    some = scanned.where(F.size("spans") > 0)
    base = F.array(*[F.lit(k) for k in BASE_KINDS])
    reported = F.filter(
        "found", lambda s: F.array_contains(base, s["kind"]) | (s["verdict"] == "live")
    )
    with_some = some.select("row", "key").join(judged(some, min_owners), "row").select(
        "key", reported.alias("found")
    )
    none = F.array_repeat(F.lit(None).cast(with_some.schema["found"].dataType.elementType), 0)
    found = with_some.unionByName(scanned.where(F.size("spans") == 0).select("key", none.alias("found")))

    def of(field: str, value: str) -> Column:
        return F.size(F.filter("found", lambda s: s[field] == value)).cast("long")

    return found.select(
        F.col("key").alias(key),
        "found",
        *[of("kind", k).alias(f"n_{k}") for k in BASE_KINDS],
        of("verdict", "live").alias("n_live"),
        of("verdict", "copied").alias("n_copied"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The spans as text: ``base_sha256`` over the base kinds, ``spans`` over all."""
    base = F.array(*[F.lit(k) for k in BASE_KINDS])
    only_base = F.filter("found", lambda s: F.array_contains(base, s["kind"]))
    return found.withColumns({"base_sha256": F.sha2(_listed(only_base), 256), "spans": _listed(F.col("found"))})


ship(__name__)
