"""The site style tree on sites laid out in ways the tables don't have."""

from __future__ import annotations

import random

import pytest

from skarv.llm.boilerplate import Tree, body_lines, read_page

WORDS = [f"{a}{b}{c}" for a in ("fjel", "vin", "stra", "gru", "hav", "mos") for b in ("do", "ra", "ste", "li") for c in ("ne", "ker", "mol", "gar", "ten")]


def _prose(rng: random.Random) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(12, 30))).capitalize() + "."


def _check(spark, pages: list[tuple[str, str, list[str], list[str]]], recall: float = 0.95, precision: float = 0.95):
    """``pages``: url, html, all lines shown, lines of the body."""
    rows = [(n, url, html, "\n".join(shown)) for n, (url, html, shown, _) in enumerate(pages)]
    got = {(r.page_id, r.line_no) for r in body_lines(spark.createDataFrame(rows, "page_id long, source_url string, html string, text string")).collect()}
    true = {(n, i + 1) for n, (_, _, shown, body) in enumerate(pages) for i, line in enumerate(shown) if line in body}
    assert len(got & true) >= recall * len(true)
    assert len(got & true) >= precision * len(got)


MENU = ["Start", "Goods and wares", "How to find us"]
FOOT = ["Sign up for the letter of the month", "Ring 12 34 56 78"]


def _site(layout, many: int = 20, title=lambda n: f"Story number {n}"):
    rng = random.Random(7)
    pages = []
    for n in range(many):
        own = [f"Story number {n}", *(_prose(rng) for _ in range(4))]
        pages.append((f"https://one.example/s/{n}", f"<html><head><title>{title(n)}</title></head><body>{layout(own)}</body></html>", [*MENU, *own, *FOOT], own))
    return pages


def _items(lines, tag="li"):
    return "".join(f"<{tag}>{line}</{tag}>" for line in lines)


def _parted(own):
    return f"<ul class=m>{_items(MENU)}</ul><div class=text><h1>{own[0]}</h1>{_items(own[1:], 'p')}</div><div class=foot>{_items(FOOT, 'p')}</div>"


def _flowing(own):
    return f"{_items(MENU, 'p')}<h1>{own[0]}</h1>{_items(own[1:], 'p')}{_items(FOOT, 'p')}"


def _headed(own):
    return f"<header><ul>{_items(MENU)}</ul></header><section class=h><h1>{own[0]}</h1></section><div class=text>{_items(own[1:], 'p')}</div><footer>{_items(FOOT, 'p')}</footer>"


LAYOUTS = {
    "parts": _parted,
    "one wrapper": lambda own: f"<div id=wrap>{_parted(own)}</div>",
    "wrappers in wrappers": lambda own: "<div>" * 30 + _parted(own) + "</div>" * 30,
    "flowing in a wrapper": lambda own: f"<div id=wrap>{_flowing(own)}</div>",
    "heading in a part of its own": _headed,
    "text beside a sidebar": lambda own: f"<div class=top>{_items(MENU, 'p')}</div><main><div class=text><h1>{own[0]}</h1>{_items(own[1:], 'p')}</div><div class=side>{_items(FOOT, 'p')}</div></main>",
    "one table": lambda own: f"<table><tr><td>{_items(MENU, 'p')}</td></tr><tr><td><h1>{own[0]}</h1>{_items(own[1:], 'p')}</td></tr><tr><td>{_items(FOOT, 'p')}</td></tr></table>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("titled", [True, False])
def test_layouts_of_a_site(spark, layout, titled):
    _check(spark, _site(LAYOUTS[layout], title=(lambda n: f"Story number {n}") if titled else (lambda n: "The one and only site")))


def test_lines_are_found_behind_many_hidden_ones(spark):
    pages = _site(lambda own: "<ul hidden class=x>" + "".join(f"<li>hidden {i}</li>" for i in range(600)) + "</ul>" + _parted(own))
    _check(spark, pages)


def test_trees_of_any_depth_and_broken_markup():
    deep = "<div>" * 5000 + "<p>below</p>" + "</div>" * 5000
    assert read_page(deep, "below", None)["line_no"] == [1]
    assert [line for line, _ in Tree("<p>one<p>two <b>and</b> <img src='x'>three<br>four<!-- no --><script>if (a<b) '<p>x</p>'</script>").lines] == ["one", "two and three", "four"]
    assert [line for line, _ in Tree("a < b &amp; c <div class=\"x'>y</div><li title='a>b'>z").lines] == ["a < b & c", "y", "z"]
    assert [line for line, _ in Tree("<p>open <a href='").lines] == ["open <a href='"]
    assert Tree("").lines == [] and Tree("<").lines == [("<", 0)]


def test_long_markup_takes_linear_time():
    for html in ("<a '" * 200_000, "<!--" * 200_000, "<div>" * 100_000, "</p>" * 200_000, "<p x=\"" * 100_000 + ">"):
        Tree(html)


def test_pages_without_anything(spark):
    frame = spark.createDataFrame([(1, None, None, None), (2, None, "", ""), (None, "https://a.example", "<p>x</p>", "x"), (3, "http://[", "<p>Only line of it</p>", "Only line of it")], "page_id long, source_url string, html string, text string")
    assert {r.page_id for r in body_lines(frame).collect()} <= {3}
    assert body_lines(frame.limit(0)).count() == 0
