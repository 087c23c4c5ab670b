"""The best region against all regions, deep nesting, and subjects that are also marks."""

import random
import time

import pytest

from moveatlas.llm import html_extract
from moveatlas.llm.html_extract import best_region, main_text, read_blocks

PROSE = "plain words that tell a story about the place " * 5


def all_regions(scores):
    """Best value of any run: its words, and the tags of all but its first block."""
    best = 0.0
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j][1] + (scores[j][0] if j > i else 0.0)
            best = max(best, total)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_best_region_equals_all_regions(seed):
    rng = random.Random(seed)
    scores = [(-float(rng.randint(0, 6)), float(rng.randint(-3, 8))) for _ in range(rng.randint(0, 25))]
    first, end = best_region(scores)
    run = scores[first:end]
    value = sum(w for _, w in run) + sum(t for t, _ in run[1:])
    assert value == all_regions(scores)


def test_main_text_is_the_best_run_of_its_blocks():
    """Extraction by every pair of blocks gives the same text."""
    rng = random.Random(5)
    for _ in range(60):
        parts = [
            f"<{t}>{'word ' * rng.randint(0, 9)}{'<a>link text</a> ' * rng.randint(0, 6)}</{t}>{'<hr>' * rng.randint(0, 9)}"
            for t in rng.choices(["p", "div", "nav", "li", "h2"], k=rng.randint(1, 12))
        ]
        page = "<body>" + "".join(parts) + "</body>"
        weights = {"word": 1.0, "link": -0.25, "tag:hr": -1.5}
        blocks = read_blocks(page)
        tags = [sum(weights.get(html_extract.tag_kind(t), html_extract.DEFAULT_TAG) for t in b.tags) for b in blocks]
        words = [(b.n_words - b.n_links - 0.25 * b.n_links) if b.kept else 0.0 for b in blocks]
        best = all_regions(list(zip(tags, words)))
        runs = {
            "\n".join(b.text for b in blocks[i:j] if b.kept)
            for i in range(len(blocks)) for j in range(i + 1, len(blocks) + 1)
            if abs(sum(words[i:j]) + sum(tags[i + 1 : j]) - best) < 1e-9
        }
        assert main_text(page, weights) in runs | ({""} if best == 0 else set())


@pytest.mark.parametrize(
    "page",
    ["<aside>x" * 30_000, "<div>" * 30_000 + "</blink>" * 30_000, "<div>" + "<b>" * 30_000 + "<li></li>" * 30_000,
     "<article>" + "<div class=menu>x" * 30_000],
)
def test_nesting_costs_linear_time(page):
    """Quadratic reading of these pages takes over a minute."""
    began = time.monotonic()
    main_text(page, {})
    assert time.monotonic() - began < 15


@pytest.mark.parametrize("mark", ["class='search'", "id=menu", "class='tags'", "role=navigation", "class='social'"])
def test_prose_under_an_unsure_mark_stays_in_an_article(mark):
    page = f"<article><p>{PROSE}</p><section {mark}><p>{PROSE}</p></section></article>"
    assert main_text(page, {}) == "\n".join([PROSE.strip()] * 2)


@pytest.mark.parametrize(
    "part",
    ["<div class=tags><a>one</a> <a>two</a></div>", f"<div class=menu><a>{PROSE}</a></div>", "<div id=search>Search here</div>",
     f"<div class='ad menu'>{PROSE}</div>", f"<div class=comments>{PROSE}</div>", f"<nav class=menu>{PROSE}</nav>",
     f"<div class=comments><div class=search>{PROSE}</div></div>"],
)
def test_lists_of_links_and_sure_marks_go(part):
    assert main_text(f"<article><p>{PROSE}</p>{part}</article>", {}) == PROSE.strip()


def test_the_mark_still_counts_outside_an_article():
    assert main_text(f"<article><p>{PROSE}</p></article><div class=menu>{PROSE}</div>", {}) == PROSE.strip()
