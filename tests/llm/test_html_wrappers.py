"""Articles inside wrappers whose class names hold a keyword."""

import pytest

from moveatlas.llm.html_extract import main_text

BODY = "<p>" + "real words of the story " * 10 + "</p>"
TEXT = ("real words of the story " * 10).strip()


@pytest.mark.parametrize("name", ["no-sidebar", "has-menu", "content-with-ads", "comments-open", "menu", "page sidebar"])
@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_wrapper_keeps_the_article(name, element):
    page = f"<body><nav>Menu</nav><div class='{name}'><{element}>{BODY}</{element}></div><footer>end</footer></body>"
    assert main_text(page, {}) == TEXT


def test_form_around_the_page():
    assert main_text(f"<form id=f><div class='ad'>buy</div><article>{BODY}</article></form>", {}) == TEXT


@pytest.mark.parametrize("name", ["search-results", "notice-period"])
def test_parts_of_the_article_stay(name):
    assert main_text(f"<article>{BODY}<div class='{name}'><p>found here</p></div></article>", {}) == TEXT + "\nfound here"


@pytest.mark.parametrize("name", ["ad", "cookie-banner", "x comments", "related"])
def test_marked_parts_go(name):
    page = f"<article>{BODY}<div class='{name}'><article>other</article><p>gone</p></div></article>"
    assert main_text(page, {}) == TEXT


def test_math_and_object_are_read():
    page = "<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold</p><object><p>shown</p></object></article>"
    assert main_text(page, {}) == "let x=1 hold\nshown"
