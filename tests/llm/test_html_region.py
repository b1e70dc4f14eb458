"""Main text of pages: attributes, several articles, broken pages, and a tree built by another parser."""

import random
import time
from html.parser import HTMLParser

import pytest

pytest.importorskip("docloom.llm")

from docloom.llm import html_extract as hx  # noqa: E402

W = hx.DEFAULT_WEIGHTS


@pytest.mark.parametrize(
    "tag",
    ['<p class="overflow-hidden">', '<p style="overflow:hidden">', '<p title="the hidden cost">', '<p data-hidden="0">', '<p data-note="display: none of it">', '<p hidden="false">', '<p class="side-effects">', '<p aria-hidden=false>'],
)
def test_words_in_attributes_hide_nothing(tag):
    assert hx.extract(f"<article><p>one two three</p>{tag}four</p></article>", W) == "one two three\n\nfour"


@pytest.mark.parametrize("tag", ["<p hidden>", "<p HIDDEN=''>", '<p aria-hidden="true">', "<p style='color:red; display : none'>", '<div class="sidebar-left">', "<aside>", "<p style='display:none !important;x:y'>"])
def test_hidden_elements_are_left_out(tag):
    assert hx.extract(f"<article><p>one two three</p>{tag}four</{tag[1:].split()[0].rstrip('>')}></article>", W) == "one two three"


def test_headline_and_lead_of_main_and_several_articles():
    body = "word " * 40
    assert hx.extract(f"<main><h1>Head line</h1><p>The lead</p><article><p>{body}</p></article><aside>x</aside></main><footer>f</footer>", W) == f"Head line\n\nThe lead\n\n{body.strip()}"
    two = f"<article><p>{body}</p></article><div>between</div><article><p>{'other ' * 30}</p></article><article><a href=x>card</a></article>"
    assert hx.extract(two, W) == f"{body.strip()}\n\n{('other ' * 30).strip()}"


@pytest.mark.parametrize(
    "page", ["<svg>" * 16_000, "<div></span>" * 16_000, "<b>" * 16_000 + "<div></div>" * 16_000, "<p><button>" + "<b>" * 16_000 + "<div></div>" * 16_000, '<a "' * 30_000, "<a '>" * 30_001, "<svg></svg>" * 16_000, "<p>" * 20_000, "<!--" * 30_000]
)
def test_broken_pages_take_time_in_proportion(page):
    start = time.perf_counter()
    hx.extract(page, W)
    assert time.perf_counter() - start < 1.5


class Tree(HTMLParser):
    """Blocks of an article by a stack of elements, for pages whose elements are all closed."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        out = tag in hx.NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "") or any(hx.marked(c) for c in (attrs.get("class") or "").split())
        if tag not in hx.INLINE:
            self.blocks.append("")
        self.stack.append((tag, out))

    def handle_endtag(self, tag):
        assert self.stack.pop()[0] == tag
        if tag not in hx.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if not any(out for _, out in self.stack) and any(t == "article" for t, _ in self.stack):
            self.blocks[-1] += data


def test_against_a_tree_on_random_pages():
    rng = random.Random(4)
    attributes = ["", ' class="lead overflow-hidden"', ' style="overflow: hidden"', ' style="display: none"', " hidden", ' title="hidden > there"', ' class="sidebar"', ' data-role="nav menu"', ' aria-hidden="true"', " class='ad-box'"]

    def element(depth):
        tag = rng.choice(["div", "section", "b", "em", "blockquote", "aside", "h2"])
        inner = "".join(rng.choice(["plain words ", "&eacute;t&eacute; ", " "]) if depth > 2 or rng.random() < 0.5 else element(depth + 1) for _ in range(rng.randrange(4)))
        return f"<{tag}{rng.choice(attributes)}>{inner}</{tag}>"

    for _ in range(300):
        page = f"<nav>menu here</nav><article><h1>{'title words ' * 20}</h1>{''.join(element(0) for _ in range(5))}</article><footer>end</footer>"
        tree = Tree()
        tree.feed(page)
        tree.close()
        assert hx.extract(page, W) == "\n\n".join(b for b in (" ".join(x.split()) for x in tree.blocks) if b), page
