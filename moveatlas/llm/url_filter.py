r"""URL filter: rules first, else a character language-model ratio.

Two smoothed variable-order Markov models are counted over all URLs that a rule
accepts or rejects (four of five, by hash): every character is predicted from the
three before it, backing off by Witten-Bell weights to shorter contexts. A URL's score
is the mean log-likelihood difference per character; the threshold that balances the
errors on the remaining fifth decides.

Characters fall into 40 classes, so a model has at most 40^4 counts whatever the size
of the corpus: the counts are summed in Spark, and one table of differences (10 MB)
goes to the executors.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits
no rule; an empty or null URL scores at the threshold and is allowed; without labelled
URLs of both kinds everything that no rule blocks is allowed; repeated rows count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from moveatlas.llm.text import ascii_lower, present, ship

CLASSES = 40
OTHER, BEGIN = 38, 39
FOLDS = 5
BIN = 0.01


@dataclass(frozen=True)
class UrlRule:
    """``net/`` or ``example.net/en/``: host, path prefix, allow or block."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (
    UrlRule("net/", "block"),
    UrlRule("example.net/en/", "allow"),
    UrlRule("example.com/de/", "block"),
    UrlRule("org/fr/", "allow"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    u = present(url)
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.substr(rest, F.length(host) + 1)
    return ascii_lower(host), F.regexp_extract(tail, r"^([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule] = RULES) -> Column:
    """The longest rule that fits, or null."""
    chain = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(
            path, F.lit(rule.path)
        )
        chain = F.when(fits, F.lit(rule.rule)).otherwise(chain)
    return chain


def rule_verdict(rule: Column, rules: Sequence[UrlRule] = RULES) -> Column:
    chain = F.lit(None).cast("string")
    for r in rules:
        chain = F.when(rule == r.rule, F.lit(r.verdict)).otherwise(chain)
    return chain


def _class_table() -> np.ndarray:
    table = np.full(256, OTHER, np.int64)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i
    for i in range(10):
        table[ord("0") + i] = 26 + i
    table[ord(".")] = 36
    table[ord("/")] = 37
    return table


TABLE = _class_table()


def grams(urls: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all four-class windows, and the index of the URL each belongs to."""
    raw = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    sizes = np.fromiter((len(b) for b in raw), np.int64, len(raw))
    ends = np.cumsum(sizes + 3)
    classes = np.full(int(ends[-1]) if len(raw) else 0, BEGIN, np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    inside = np.arange(sizes.sum()) + 3 * (owner + 1)
    classes[inside] = TABLE[np.frombuffer(b"".join(raw), np.uint8)]
    codes = classes[inside]
    for back in (1, 2, 3):
        codes = codes + classes[inside - back] * CLASSES**back
    return codes, owner


def gram_counts(labelled: DataFrame) -> DataFrame:
    """good, code, n over labelled URLs (columns url, good)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for good, part in batch.groupby("good"):
                codes, n = np.unique(grams(list(part["url"]))[0], return_counts=True)
                yield pd.DataFrame({"good": bool(good), "code": codes, "n": n})

    partial = labelled.select("url", "good").mapInPandas(count, "good boolean, code long, n long")
    return partial.groupBy("good", "code").agg(F.sum("n").alias("n"))


def log_model(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log probability of the last class of every window, Witten-Bell interpolated."""
    full = np.zeros((CLASSES,) * 4)
    full.ravel()[codes] = n
    p = np.full(CLASSES, 1.0 / CLASSES)
    for order in range(4):
        counts = full.sum(axis=tuple(range(3 - order)))
        seen, total = (counts > 0).sum(-1, keepdims=True), counts.sum(-1, keepdims=True)
        weight = seen + (total == 0)
        p = (counts + weight * p) / (total + weight)
    return np.log(p).ravel()


@dataclass(frozen=True)
class UrlModel:
    """Difference table by window code, and the calibrated threshold."""

    table: np.ndarray
    threshold: float


def scores(urls: Sequence[str | None], table: np.ndarray) -> np.ndarray:
    """Mean log-likelihood difference per byte; NaN for an empty URL."""
    codes, owner = grams(urls)
    n = np.bincount(owner, minlength=len(urls))
    total = np.bincount(owner, weights=table[codes], minlength=len(urls))
    return np.where(n > 0, total / np.maximum(n, 1), np.nan)


def scored(urls: DataFrame, table: np.ndarray, url: str = "url") -> DataFrame:
    """``urls`` plus ``score``."""
    schema = StructType([*urls.schema, StructField("score", DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [u if isinstance(u, str) else None for u in batch[url]]
            yield batch.assign(score=scores(texts, table))

    return urls.mapInPandas(score, schema)


def balanced_threshold(bins: np.ndarray, good: np.ndarray, n: np.ndarray) -> float:
    """The bin edge with the lowest sum of both error rates, nearest to zero."""
    goods, bads = n[good].sum(), n[~good].sum()
    if not goods or not bads:
        return 0.0
    edges = np.unique(np.concatenate([bins, bins + 1, [0]]))
    error = [n[good & (bins < e)].sum() / goods + n[~good & (bins >= e)].sum() / bads for e in edges]
    return float(min(zip(error, abs(edges), edges, strict=True))[2] * BIN)


def fit(labelled: DataFrame) -> UrlModel | None:
    """Train on four of five labelled URLs, calibrate on the fifth; None if one kind is missing."""
    labelled = labelled.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    counts = gram_counts(labelled.where("fold > 0")).toPandas()
    good = counts["good"].to_numpy(bool)
    if good.all() or not good.any():
        return None
    logs = [
        log_model(counts["code"].to_numpy()[side], counts["n"].to_numpy()[side]) for side in (good, ~good)
    ]
    table = (logs[0] - logs[1]).astype(np.float32)
    held = scored(labelled.where("fold = 0").select("url", "good"), table)
    spread = (
        held.where(~F.isnan("score")).groupBy("good", F.floor(F.col("score") / BIN).alias("bin"))
        .agg(F.count("*").alias("n")).toPandas()
    )
    spread = spread.sort_values(["good", "bin"])
    return UrlModel(table, balanced_threshold(
        spread["bin"].to_numpy(int), spread["good"].to_numpy(bool), spread["n"].to_numpy(int)
    ))


def filter_urls(pages: DataFrame, *, url: str = "url", rules: Sequence[UrlRule] = RULES) -> DataFrame:
    """``pages`` plus host, path, rule, score and verdict; those names are replaced."""
    host, path = url_parts(F.col(url))
    parts = pages.withColumns({"host": host, "path": path})
    judged = parts.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    by_rule = rule_verdict(F.col("rule"), rules)
    labelled = judged.where(F.col("rule").isNotNull()).select(
        F.col(url).alias("url"), (by_rule == "allow").alias("good")
    )
    model = fit(labelled)
    if model is None:
        with_score = judged.withColumn("score", F.lit(None).cast("double"))
        ratio = F.lit("allow")
    else:
        with_score = scored(judged.drop("score"), model.table, url)
        enough = F.col("score").isNull() | F.isnan("score") | (F.col("score") >= model.threshold)
        ratio = F.when(enough, "allow").otherwise("block")
    return with_score.withColumn("verdict", F.coalesce(by_rule, ratio))


ship(__name__)
