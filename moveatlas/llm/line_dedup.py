r"""Line dedup by site-relative frequency.

For every site, the distinct page texts that hold a line are divided by the site's
distinct page texts; lines above the boilerplate ratio, on at least ``min_pages``
pages, are dropped. Copies of a page count once, so that a copied page does not turn
its own content into boilerplate. Lines are compared without white space at their
ends; blank lines are never counted or dropped.

Lines travel as two independent 64-bit hashes with their site; a line on many pages
shrinks to one row per task and page text before it is counted by key. A site's list
of dropped lines holds at most (lines per page / ratio) entries and is cut by hash into
buckets of about ``PER_BUCKET`` lines, so that a line is compared with one bucket. The lists are
broadcast only if all their lines together stay within ``max_lines``; beyond it they
are joined in ``SALTS`` copies, so that the pages of one large site are dealt over as
many tasks. Both ways drop the same lines.

Defined cases: a null text stays null and is no page; an empty text has one blank
line; a null site is a site of its own; repeated rows are copies of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveatlas.llm.text import BROADCAST_ROWS, let, stored, with_hint

RATIO = 0.05
MIN_PAGES = 10
SALTS = 64
PER_BUCKET = 8


def _codes(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def boilerplate_lines(
    docs: DataFrame, *, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """site, dropped: the hashes of the lines that are boilerplate on each site."""
    pages = docs.where(F.col(text).isNotNull()).select(
        F.col(site).alias("site"), _codes(F.col(text)).alias("page"), F.split(F.col(text), "\n").alias("lines")
    )
    counted = pages.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("n_pages"))
    bare = F.filter(F.transform("lines", _bare), lambda line: line != "")
    lines = pages.select(
        "site", "page", F.explode(F.array_distinct(F.transform(bare, _codes))).alias("line")
    ).distinct()
    often = lines.groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    over = often.alias("o").join(
        with_hint(stored(counted, "site-pages")).alias("c"), F.col("o.site").eqNullSafe(F.col("c.site"))
    ).where(F.col("n") > F.lit(ratio) * F.col("n_pages"))
    return over.groupBy(F.col("o.site").alias("site")).agg(F.collect_list("line").alias("dropped"))


def in_buckets(found: DataFrame) -> DataFrame:
    """site, buckets: the lists (site, dropped) as arrays by ``pmod(a, number of buckets)``."""
    sized = found.withColumn("of", F.ceil(F.size("dropped") / PER_BUCKET).cast("int"))
    lines = sized.select("site", "of", F.explode("dropped").alias("line"))
    dealt = lines.select("site", F.pmod(F.col("line.a"), F.col("of")).cast("int").alias("bucket"), "line")
    every = sized.select("site", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("bucket"))
    every = every.withColumn("line", F.lit(None).cast(dealt.schema["line"].dataType))
    lists = dealt.unionByName(every).groupBy("site", "bucket").agg(F.collect_list("line").alias("lines"))
    in_order = F.sort_array(F.collect_list(F.struct("bucket", "lines")))
    return lists.groupBy("site").agg(in_order["lines"].alias("buckets"))


def _holds(buckets: Column, line: Column) -> Column:
    """Whether the bucket of the line's hash holds the line."""

    def found(code: Column) -> Column:
        return F.array_contains(F.get(buckets, F.pmod(code["a"], F.size(buckets)).cast("int")), code)

    return let(_codes(line), found)


def _with_lists(d: DataFrame, found: DataFrame, site: str, text: str, max_lines: int) -> DataFrame:
    """``d`` (alias d) with the buckets of its site (alias f)."""
    same = F.col(f"d.{site}").eqNullSafe(F.col("f.site"))
    lists = stored(in_buckets(found), "boilerplate-buckets")
    if (found.agg(F.sum(F.size("dropped"))).first()[0] or 0) <= max_lines:
        return d.join(F.broadcast(lists).alias("f"), same, "left")
    salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = F.pmod(F.xxhash64(F.col(f"d.{text}")), F.lit(SALTS)).cast("int")
    return d.join(salted.alias("f"), same & (dealt == F.col("f.salt")), "left")


def drop_boilerplate(
    docs: DataFrame,
    *,
    site: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    max_lines: int = BROADCAST_ROWS,
) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, plus n_lines and n_dropped.

    Columns of the two added names are replaced.
    """
    found = stored(boilerplate_lines(docs, site=site, text=text, ratio=ratio, min_pages=min_pages), "boilerplate")
    d = docs.drop("n_lines", "n_dropped").alias("d")
    joined = _with_lists(d, found, site, text, max_lines)
    lines = F.split(F.col(f"d.{text}"), "\n")
    buckets = F.col("f.buckets")
    kept = F.filter(
        lines,
        lambda line: let(_bare(line), lambda b: (b == "") | ~_holds(buckets, b)),
    )
    own = [F.col(f"d.`{c}`") for c in d.columns if c != text]
    cut = joined.select(
        *own, F.col(f"d.{text}").alias("__text"), lines.alias("__lines"),
        F.when(buckets.isNull(), lines).otherwise(kept).alias("__kept"),
    )
    changed = F.size("__kept") < F.size("__lines")
    done = cut.withColumns(
        {
            text: F.when(changed, F.array_join("__kept", "\n")).otherwise(F.col("__text")),
            "n_lines": F.coalesce(F.size("__lines"), F.lit(0)).cast("long"),
            "n_dropped": F.coalesce(F.size("__lines") - F.size("__kept"), F.lit(0)).cast("long"),
        }
    )
    order = [F.col(f"`{c}`") for c in d.columns]
    return done.select(*order, "n_lines", "n_dropped")
