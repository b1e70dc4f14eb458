import random
import time
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from docloom.functions import html
from docloom.plans.oracle import CLEAN_CASES, LINK_CASES
from docloom.sources import files


@pytest.mark.parametrize("page, lines", CLEAN_CASES)
def test_cases(page, lines):
    assert html.visible_text(page) == lines


class Tree(HTMLParser):
    """Texts with the elements around them, by another parser."""

    def __init__(self):
        super().__init__()
        self.stack, self.lines, self.links, self.open = [], [], [], True

    def handle_starttag(self, tag, attrs):
        self.open = True
        if tag == "a" and "href" in dict(attrs):
            self.links.append(dict(attrs)["href"] or "")
        if tag not in html._VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.open = True
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_comment(self, data):
        self.open = True

    def handle_data(self, data):
        if not set(self.stack) & set(html.DROPPED_ELEMENTS):
            if self.open:
                self.lines.append("")
            self.lines[-1] += data
            self.open = False


def test_against_the_library_parser():
    rng = random.Random(1)
    parts = ["<div>", "</div>", "<nav class='x'>", "</nav>", "<p title=\"a>b\">", "</p>", "<aside>", "</aside>", "<br>", "<img src=x>", "text ", "&eacute; ", "&#8212;", "<!-- c -->", "<a href='/x'>", "<A HREF=/y?a=1&amp;b>", "</a>", "<header>", "</header>", "<li>"]
    for _ in range(400):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        tree = Tree()
        tree.feed(page)
        tree.close()
        assert html.visible_text(page) == "\n".join(x.strip() for x in tree.lines if x.strip()), page
        assert html.link_targets(page) == tree.links


def test_odd_pages():
    assert html.visible_text(None) is None and html.visible_text("") == "" and html.link_targets(None) == []
    assert html.visible_text("a < b <") == "a < b <"
    assert html.link_targets("<script><a href='/no'></script><!--<a href='/no'>--><a data-href='/no' title='href=/no' href = \"/yes\">") == ["/yes"]
    assert html.link_targets("<a>x</a><a href>y</a>") == [""]


@pytest.mark.parametrize("page", ["<svg>" * 60_000, "<div></span>" * 40_000, "<a \"" * 60_000, "<nav" * 60_000, "<script>" * 20_000, "<!--" * 60_000])
def test_time_in_proportion(page):
    start = time.perf_counter()
    html.visible_text(page)
    assert time.perf_counter() - start < 2


def test_resolve_like_the_library(spark):
    rng = random.Random(2)
    bases = ["http://h.example/a/d/e", "http://h.example", "https://h.example/", "http://h.example/a/b/?x=/y#z", "http://h.example/a//b/c.html?q"]
    bits = ["..", ".", "x", "y.html", "", "a b", "é"]
    hrefs = [h for h, _ in LINK_CASES] + ["/".join(rng.choice(bits) for _ in range(rng.randrange(1, 6))) + rng.choice(["", "?k=../v", "#f"]) for _ in range(200)]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    for r in rows.select("*", files.resolve(F.col("base"), F.col("href")).alias("link")).collect():
        if not r.href.startswith("//"):  # an empty host is the library's own case
            assert r.link == urljoin(r.base, r.href.strip()), (r.base, r.href)


def test_children_by_dot_segments(spark):
    page = spark.createDataFrame([("http://h.example/a/d/e", "<a href='../b'>1</a><a href=./c>2</a><a href=\"/a/d/c\">again</a><a href='http://o.example/'>other</a>")], "url string, html string")
    assert [r.link for r in files.crawl_frontier(page).orderBy("ord").collect()] == ["http://h.example/a/d/e", "http://h.example/a/b", "http://h.example/a/d/c"]


@pytest.mark.parametrize("page", ["<title>a&amp;&amp</title><p>b", "<p>x &copy 2</p>&lt", "<p>&amp&amp;amp</p>", "<p>a&nosuch b&#233</p>"])
def test_references_without_a_semicolon(page):
    """Titles that are cut off inside a reference, as in larger tables."""
    tree = Tree()
    tree.feed(page)
    tree.close()
    assert html.visible_text(page) == "\n".join(x.strip() for x in tree.lines if x.strip())
