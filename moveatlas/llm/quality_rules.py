r"""Quality rules: text statistics and a learned decision list over them.

Statistics are native expressions over the whole text. The list is learned by
sequential covering: conjunctions of thresholds are grown by FOIL gain on two thirds
of a bounded, labelled sample of statistics and pruned on the last third, where any
condition may go; a rule is kept if it is precise there and covers enough bad documents.
Documents a kept rule covers leave the sample before the next rule is grown; of a rule
that is not kept only the bad ones are set aside, so that another rule is tried. Documents
that the base rule rejects are not learned from: the list never sees them. The rules become
one ordered chain of Spark conditions.

Bounds of the list, whatever the size of the data: a sample of ``MAX_LABELLED`` documents,
``MAX_RULES`` rules of ``MAX_CONDITIONS`` conditions, ``MAX_FAILED`` rules not kept; a rule
covers ``MIN_COVERED`` bad documents and a share ``MIN_SHARE`` of the sample.

Defined cases: a null text has no words and fails the base rule; a document with
several labels takes the lowest; without labels of both kinds the list is empty and
only the base rule rejects; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas.llm.text import apart, let, present, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEATED = 50
MAX_LABELLED = 4000
MAX_RULES = 12
MAX_CONDITIONS = 4
MAX_FAILED = 6
MIN_PRECISION = 0.95
MIN_COVERED = 4
MIN_SHARE = 0.005
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
FEATURES = (
    "n_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share",
    "upper_share", "marks_per_word", "words_per_line",
)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(1), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))

    def covered(codes: Column) -> Column:
        tagged = F.sort_array(F.transform(codes, lambda c, i: F.struct(c.alias("c"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["c"].eqNullSafe(x["c"])) | (F.get(s, i + 1)["c"].eqNullSafe(x["c"])),
            )

        at = F.sort_array(F.transform(let(tagged, twice), lambda x: x["i"]))
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
        return F.aggregate(
            at, begin,
            lambda a, i: F.struct(
                (a["n"] + i + 3 - F.greatest(a["until"], i)).alias("n"), (i + 3).alias("until")
            ),
            lambda a: a["n"],
        )

    codes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(3))))
    return let(codes, lambda c: F.when(F.size(F.array_distinct(c)) == F.size(c), 0).otherwise(covered(c)))


def with_stats(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Add the columns of ``STATS``, replacing columns of these names."""
    t = present(F.col(text))
    lines = F.split(t, "\n")
    with_word = F.filter(lines, lambda line: F.translate(line, BLANKS, "") != "")
    counts = F.struct(
        F.length(F.translate(t, BLANKS, "")).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        let(with_word, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        (F.length(t) - F.length(F.translate(t, "!?:;/=@_{}[]()", ""))).alias("n_marks"),
        let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("rep"))).alias("w"),
    )
    made = docs.withColumn("__s", counts)
    named = {
        "n_words": "w.n", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "lines.dup",
        "n_repeat_words": "w.rep", "n_upper": "n_upper", "n_marks": "n_marks", "n_lines": "lines.n",
    }
    return made.withColumns({k: F.col(f"__s.{v}").cast("long") for k, v in named.items()}).drop("__s")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios over the statistics, all defined for empty texts."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / n,
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "marks_per_word": F.col("n_marks") / n,
        "words_per_line": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        c = of[self.feature]
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    mask = np.ones(len(next(iter(x.values()))), bool)
    for condition in rule:
        mask &= condition.holds(x)
    return mask


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition of the highest FOIL gain until no good document is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (~bad[inside]).any():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for name in FEATURES:
            values = x[name]
            for threshold in np.unique(np.quantile(values[inside], np.linspace(0, 1, 65))):
                for above in (True, False):
                    condition = Condition(name, above, float(threshold))
                    now = inside & condition.holds(x)
                    p1, n1 = bad[now].sum(), (~bad[now]).sum()
                    if p1 == 0:
                        continue
                    g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                    if g > gain:
                        best, gain = condition, g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    mask = covered(rule, x)
    p, n = int(bad[mask].sum()), int((~bad[mask]).sum())
    return ((p - n) / (p + n) if p + n else -1.0, p)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop the condition whose loss helps most, or harms nothing, while there is one."""
    while len(rule) > 1:
        fewer = [rule[:i] + rule[i + 1 :] for i in range(len(rule))]
        best = max(fewer, key=lambda r: _worth(r, x, bad))
        if _worth(best, x, bad) < _worth(rule, x, bad):
            break
        rule = best
    return rule


def _centre(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Move every threshold to the middle of the gap it stands in."""
    moved: list[Condition] = []
    for i, c in enumerate(rule):
        inside = covered((*moved, *rule[i + 1 :]), x) if len(rule) > 1 else np.ones(len(bad), bool)
        values = x[c.feature]
        held = values[inside & bad & c.holds(x)]
        left = values[inside & ~c.holds(x)]
        if len(held) and len(left):
            edge = (held.min() + left.max()) / 2 if c.above else (held.max() + left.min()) / 2
            c = Condition(c.feature, c.above, float(edge))
        moved.append(c)
    return tuple(moved)


def _held_out(bad: np.ndarray) -> np.ndarray:
    """Every third document of either label, in order."""
    part = np.zeros(len(bad), bool)
    for label in (True, False):
        part[np.flatnonzero(bad == label)[2::3]] = True
    return part


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules that reject; ``x`` holds feature arrays, ``bad`` the labels."""
    part = _held_out(bad)
    least = max(MIN_COVERED, MIN_SHARE * len(bad))
    grow = {k: v[~part] for k, v in x.items()}
    prune = {k: v[part] for k, v in x.items()}
    bad_grow, bad_prune = bad[~part], bad[part]
    rules: list[Rule] = []
    failed = 0
    while len(rules) < MAX_RULES and failed < MAX_FAILED and bad_grow.any() and (~bad_grow).any() and bad_prune.any():
        rule = _grow(grow, bad_grow)
        if not rule:
            break
        rule = _centre(_prune(rule, prune, bad_prune), grow, bad_grow)
        mask, held = covered(rule, grow), covered(rule, prune)
        p, n = bad_grow[mask].sum() + bad_prune[held].sum(), (~bad_grow[mask]).sum() + (~bad_prune[held]).sum()
        held_p, held_n = bad_prune[held].sum(), (~bad_prune[held]).sum()
        precise = p >= MIN_PRECISION * (p + n) and held_p >= MIN_PRECISION * (held_p + held_n)
        if held_p and p >= least and precise:
            rules.append(rule)
        else:
            failed += 1
            mask &= bad_grow
            held &= False
            if not mask.any():
                break
        grow, bad_grow = {k: v[~mask] for k, v in grow.items()}, bad_grow[~mask]
        prune, bad_prune = {k: v[~held] for k, v in prune.items()}, bad_prune[~held]
    return rules


def labelled_stats(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
    label: str = "quality", max_labelled: int = MAX_LABELLED,
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and labels (True: bad) of at most ``max_labelled`` documents, but for
    those that the base rule rejects.

    The sample is the labelled documents with the smallest id hashes, whatever the
    size of the tables; of rows that share an id the smallest text counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    chosen = (
        known.groupBy(F.col(key).alias("__id")).agg(F.min(label).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    )
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id")
    rows = rows.groupBy("__id", "__label").agg(F.min("text").alias("text"))
    rows = with_stats(rows).where(~base_failed()).select("__id", "__label", *[c.alias(k) for k, c in features().items()])
    found = rows.toPandas().sort_values(["__id", *FEATURES])
    return {k: found[k].to_numpy(float) for k in FEATURES}, (found["__label"].to_numpy(int) == 0)


def fit_rules(docs: DataFrame, labels: DataFrame, **options) -> list[Rule]:
    """Learn the decision list from the labelled sample."""
    x, bad = labelled_stats(docs, labels, **options)
    return learn_list(x, bad) if len(bad) else []


def rejecting_rule(rules: list[Rule]) -> Column:
    """1-based number of the first rule that covers a document with ``STATS``; else 0."""
    of = features()
    chain = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column(of)
        chain = F.when(holds, F.lit(i)).otherwise(chain)
    return chain


def judge(docs: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """``docs`` with statistics, base_failed, rule and kept; those names are replaced."""
    stats = with_stats(docs, text=text)
    judged = stats.withColumns({"base_failed": base_failed(), "rule": rejecting_rule(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def describe(rules: list[Rule]) -> list[str]:
    """The list in words."""
    return [
        " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule) for rule in rules
    ]


def keep_good(docs: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor the list rejects."""
    names = (*STATS, "base_failed", "rule", "kept")
    return apart(docs, names, lambda d: judge(d, rules, text=text).where("kept"))
