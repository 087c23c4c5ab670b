r"""HTML main text by the best-scoring contiguous region of a page.

A page is read as a sequence of words and tags. Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments are known by element or by a whole
class, id or role, and their words score nothing, unless the article is among them; inside
an article, marks that are common subjects (``UNSURE``) give way to prose. Every other word scores
positive and every tag negative, by log-odds from labelled pages: pages with exactly
one ``article`` or ``main`` element, whose inside is content. Words of links are weighed on their own and may score negative. One linear scan finds the
contiguous run of blocks with the highest score; its words are the main text.

The weights come from at most ``MAX_LABELLED`` labelled pages, those with the smallest
id hashes; every page is then extracted whole, in place, without a shuffle.

Defined cases: null or empty html, or a page without words, gives the empty text; a
tag that is never closed ends with its parent; an open comment or tag runs to the end;
without labelled pages fixed weights are used; repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from moveatlas.llm.text import ship

MAX_LABELLED = 2000
DEFAULT_WORD, DEFAULT_LINK, DEFAULT_TAG = 1.0, -0.25, -0.05
#: Element names by their part in a page.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg"}
UNSEEN = {"script", "style", "noscript", "template", "meta", "link"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br "
    "math mfrac mi mn mo mover mrow ms msqrt mstyle msub msubsup msup mtext munder semantics".split()
)
CONTENT = {"article", "main"}
#: Words in class, id and role attributes that mark boilerplate.
MARKED = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments "
    "complementary contentinfo cookie cookies copyright disclaimer disqus footer menu "
    "modal nav navbar navigation navigate newsletter notice pagination pager popup promo "
    "promoted promotion recommended related reply replies respond search share sharing "
    "sidebar sidebars signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
OUTSIDE_ONLY = {"header", "masthead", "topbar"}
#: Marks that name subjects as well as page parts; inside an article,
#: an element so marked stays if it has ``PROSE`` words outside links, and most are.
UNSURE = set("menu navigation search social tags toolbar".split())
PROSE = 30
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
NAMES = re.compile(r"[a-z]+")


def _says(value: str, marks: set[str]) -> bool:
    """Whether one whole class, id or role consists of ``marks``: cookie-banner, not no-sidebar."""
    return any((found := NAMES.findall(token)) and marks.issuperset(found) for token in value.lower().strip("\"'").split())


@dataclass
class Block:
    """The words of one block of a page, and the tags since the block before."""

    text: str
    n_words: int
    n_links: int
    tags: list[str]
    kept: bool
    inside: bool


@dataclass
class Dropped:
    """An element left out: its name, place of words in the page, and whether prose may save it."""

    name: str
    unsure: bool
    words: int
    linked: int
    inside: int

    def close(self, words: int, linked: int, inside: int) -> None:
        """Turn the counts before the element into those of the element."""
        self.words, self.linked, self.inside = words - self.words, linked - self.linked, inside - self.inside

    def is_prose(self) -> bool:
        return self.unsure and self.words - self.linked >= PROSE and 2 * self.linked < self.words


def _is_unsure(name: str, attributes: str) -> bool:
    """Whether only ``UNSURE`` words mark the element."""
    values = ATTRIBUTE.findall(attributes)
    return name not in BOILERPLATE and not any(_says(v, MARKED - UNSURE) for v in values)


def _is_marked(name: str, attributes: str, in_content: bool) -> bool:
    if name in BOILERPLATE:
        return True
    if name == "header":
        return not in_content
    if not attributes or name in CONTENT or name in ("html", "body"):
        return False
    for value in ATTRIBUTE.findall(attributes):
        if _says(value, MARKED if in_content else MARKED | OUTSIDE_ONLY):
            return True
    return False


def read_blocks(page: str) -> list[Block]:
    """Blocks in page order, ending with one that holds the last tags.

    If no article or main would be left, the marked elements that hold one are spared,
    as are marked ones and forms that hold over half of the words of the page.
    """
    blocks, held = _read(page, set())
    total = sum(b.n_words for b in blocks)
    if any(b.kept and b.inside for b in blocks):
        spared = {at for at, d in held.items() if d.is_prose()}
    else:
        spared = {
            at for at, d in held.items()
            if d.inside or (2 * d.words > total and (d.name == "form" or d.name not in BOILERPLATE))
        }
    return _read(page, spared)[0] if spared else blocks


def _read(page: str, spared: set[int]) -> tuple[list[Block], dict[int, Dropped]]:
    """Blocks, and every dropped element by its place."""
    blocks: list[Block] = []
    held: dict[int, Dropped] = {}
    opened: list[Dropped] = []
    stack: list[tuple[str, bool, bool]] = []
    block_level: list[int] = []
    open_names: Counter = Counter()
    pieces: list[str] = []
    tags: list[str] = []
    dropped = content = links = linked = seen = seen_linked = seen_inside = 0

    def add(piece: str) -> None:
        nonlocal linked
        pieces.append(piece)
        if links:
            linked += len(piece.split())

    def flush() -> None:
        nonlocal linked, seen, seen_linked, seen_inside
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            n = text.count(" ") + 1
            blocks.append(Block(text, n, min(n, linked), tags[:], not dropped, content > 0))
            tags.clear()
            seen += n
            seen_linked += min(n, linked)
            seen_inside += n if content else 0
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal dropped, content, links
        while len(stack) > depth:
            name, drop, inside = stack.pop()
            dropped -= drop
            if drop:
                opened.pop().close(seen, seen_linked, seen_inside)
            content -= inside
            links -= name == "a"
            open_names[name] -= 1
            if name not in INLINE:
                block_level.pop()

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name == "br":
            add(" ")
        elif name not in INLINE and name not in UNSEEN:
            flush()
        drop = not closing and m.start() not in spared and _is_marked(name, m[3] or "", content > 0)
        if not dropped and not drop and name not in RAW:
            tags.append(name)
        if name == "br":
            continue
        if name in RAW:
            if not closing and not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if closing:
            if open_names[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                ends_dropped = any(drop for _, drop, _ in stack[depth:])
                if ends_dropped and name in INLINE:
                    flush()
                pop_to(depth)
                if ends_dropped and not dropped and tags and tags[-1] == name:
                    tags.pop()
            continue
        if name in VOID or m[0].endswith("/>"):
            continue
        if name not in INLINE and block_level and name != "html":
            parent = stack[block_level[-1]][0]
            if parent == "p" or (parent == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                pop_to(block_level[-1])
        if drop:
            flush()
            unsure = content > 0 and not dropped and _is_unsure(name, m[3] or "")
            held[m.start()] = Dropped(name, unsure, seen, seen_linked, seen_inside)
            opened.append(held[m.start()])
        open_names[name] += 1
        if name not in INLINE:
            block_level.append(len(stack))
        stack.append((name, drop, name in CONTENT))
        dropped += drop
        links += name == "a"
        content += name in CONTENT
    flush()
    pop_to(0)
    blocks.append(Block("", 0, 0, tags[:], False, False))
    return blocks, held


def tag_kind(name: str) -> str:
    known = name in INLINE or name in VOID or name in CONTENT or name in BOILERPLATE or name in RAW
    return f"tag:{name}" if known or re.fullmatch(r"h[1-6]|p|div|section|ul|ol|li|table|tr|td|th|pre|blockquote|html|body|header", name) else "tag:other"


def label_counts(page: str) -> Counter:
    """Counts of (token, inside) of a labelled page; empty for other pages."""
    if len(re.findall(r"<(?:article|main)\b", page, re.I)) != 1:
        return Counter()
    counts: Counter = Counter()
    for block in read_blocks(page):
        content = block.kept and block.inside
        counts["word", content] += block.n_words - block.n_links
        counts["link", content] += block.n_links
        for name in block.tags:
            counts[tag_kind(name), block.inside and name not in CONTENT] += 1
    return counts


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds: words at least 0.25, words of links at least -0.25, tags at most -0.05."""
    names = {name for name, _ in counts}
    inside = sum(n for (_, i), n in counts.items() if i) + len(names)
    outside = sum(n for (_, i), n in counts.items() if not i) + len(names)
    if not names:
        return {}
    made = {}
    for name in names:
        odds = np.log((counts.get((name, True), 0) + 1) / inside) - np.log(
            (counts.get((name, False), 0) + 1) / outside
        )
        low, high = {"word": (0.25, 4.0), "link": (-0.25, 4.0)}.get(name, (-12.0, -0.05))
        made[name] = float(np.clip(odds, low, high))
    return made


def best_region(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """First and last+1 block of the best run; a block costs its tags only inside a run."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, (tags, words) in enumerate(scores):
        if total + tags > 0:
            total += tags + words
        else:
            total, start = words, i
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The words of the best region, one line per block."""
    if not page:
        return ""
    blocks = read_blocks(page)
    word, link = weights.get("word", DEFAULT_WORD), weights.get("link", DEFAULT_LINK)
    scores = [
        (
            sum(weights.get(tag_kind(t), DEFAULT_TAG) for t in b.tags),
            word * (b.n_words - b.n_links) + link * b.n_links if b.kept else 0.0,
        )
        for b in blocks
    ]
    first, end = best_region(scores)
    return "\n".join(b.text for b in blocks[first:end] if b.kept)


def fit_weights(
    pages: DataFrame, *, key: str = "page_id", html: str = "html", max_labelled: int = MAX_LABELLED
) -> dict[str, float]:
    """Token weights from the labelled pages among the first ``max_labelled`` by id hash."""
    chosen = (
        pages.where(F.col(key).isNotNull()).select(F.col(key).alias("__id")).distinct()
        .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    )
    sample = pages.join(F.broadcast(chosen), F.col(key) == F.col("__id"), "left_semi").select(
        F.col(html).alias("html")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch["html"]:
                if isinstance(page, str):
                    total.update(label_counts(page))
            yield pd.DataFrame(
                [(name, inside, n) for (name, inside), n in total.items()], columns=["token", "inside", "n"]
            )

    counted = sample.mapInPandas(count, "token string, inside boolean, n long")
    rows = counted.groupBy("token", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_from({(r.token, r.inside): r.n for r in rows})


def extract(pages: DataFrame, weights: dict[str, float], *, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in ``out`` instead of the html."""
    schema = StructType([*pages.drop(html, out).schema, StructField(out, StringType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p if isinstance(p, str) else None, weights) for p in batch[html]]
            yield batch.drop(columns=[c for c in (html, out) if c in batch]).assign(**{out: texts})

    return pages.mapInPandas(read, schema)


ship(__name__)
