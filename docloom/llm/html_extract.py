"""Operator 6, main text of HTML pages by the maximum-scoring subsequence.

A page is a row of tokens: words, tags, words inside links and words inside boilerplate elements (menus,
footers, adverts, forms, comments and so on, by tag name or by class, id and role). Plain words score positive,
all others negative or less; the weights are log odds counted on labelled pages. A page labels itself where it
marks its content with <article> or <main>: tokens in there and outside boilerplate are content. One linear
scan finds the contiguous region of the greatest sum. If article elements hold most of the region's words, the text is
that of the greatest of them and of others that have at least a quarter of its words; a main element around a single one also gives
what it holds before (a headline and lead, say) and what the region has of it behind. Where there is no article, main counts as one. The text
comes out block by block, boilerplate elements left out. An element is hidden if it has the attribute hidden, aria-hidden=true
or a style that declares display:none; the same words in other attributes or class names say nothing.

Weights are counted over all pages, by class of token; that table is as long as the list of HTML's tag names.

Cases: null, empty and tagless pages (all text is one region); unclosed elements end where their parent does,
and unfinished tags or comments at the end are dropped; very long pages are read whole, in time in proportion to
their length; of regions with equal sums the earliest counts, the shortest of those; pages without a labelled one in
the corpus use the default weights; repeated rows come out once per row, an empty table gives an empty one; columns
named text and n_chars are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

#: Elements whose content is no text; those of the first kind run to the end of the page if they aren't closed, the
#: others are tags like any other then.
_RAW, _CLOSED = "script|style|textarea", "noscript|template|iframe|svg|select|object|canvas|video|audio"
_ATTRIBUTES = r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<({_RAW})\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_END_OF = {name: re.compile(rf"</{name}\s*>", re.I) for name in _CLOSED.split("|")}
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mfenced semantics".split())
#: Elements that are never part of an article, and names that mark others as such.
NEVER = frozenset("nav footer aside form button head title dialog menu".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu menubar breadcrumb breadcrumbs sidebar side footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments reply replies disqus discussion related recommended recommendations widget toolbar pager pagination contentinfo complementary".split()
)
#: What else names of such elements are made of: a name counts if each of its parts is of either kind and one a mark,
#: so `sidebar-left` and `cookie-notice` do, `related-work` and `side-effects` don't.
PLACES = frozenset("left right top bottom upper lower inner outer box bar block blocks slot container wrapper wrap area panel pane unit section region row col column list item items link links button buttons icon icons site page global main inline sticky fixed form message text title header body content small large mobile desktop primary secondary posts articles stories post article entry form count feed thread".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Used where no page is labelled.
DEFAULT_WEIGHTS = {"word": 1.0, "linked": -0.5, "aside": -2.0, "other": -1.0}


def is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    values = {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(attributes)}
    if values.get("hidden", "false").lower() != "false" or values.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(values.get("style", "")):
        return True
    return any(marked(name) for key in ("class", "id", "role") for name in values.get(key, "").split())


def marked(name: str) -> bool:
    """Whether a class, id or role names boilerplate: all its parts are marks or places (or numbers), one is a mark."""
    parts = [x.lower() for x in _NAMES.findall(name)]
    return any(x in MARKS for x in parts) and all(x in MARKS or x in PLACES or x.isdigit() for x in parts)


class Piece:
    """A tag or a run of text, with what stands around it."""

    __slots__ = ("kind", "text", "words", "content", "element")

    def __init__(self, kind: str, text: str, words: int, content: bool, element: int):
        self.kind, self.text, self.words, self.content, self.element = kind, text, words, content, element


class Elements:
    """Article and main elements: first and last piece of each, and the main or article around it, or -1."""

    def __init__(self) -> None:
        self.span: dict[int, tuple[int, int]] = {}
        self.outer: dict[int, int] = {}
        self.tag: dict[int, str] = {}

    def article(self, element: int) -> int:
        """The outermost article around a piece; its main where there is no article; -1 for none."""
        found = main = -1
        while element >= 0:
            if self.tag[element] == "article":
                found = element
            else:
                main = element
            element = self.outer[element]
        return found if found >= 0 else main

    def main(self, element: int) -> int:
        while element >= 0 and self.tag[element] != "main":
            element = self.outer[element]
        return element


def parse(page: str) -> tuple[list[Piece], Elements]:
    """The page's pieces and its article and main elements. Text pieces are of kind word, linked or aside; element is the
    innermost article or main around, or -1."""
    pieces: list[Piece] = []
    found = Elements()
    # tag, whether it starts boilerplate, article around, and the place of the nearest element that isn't inline
    stack: list[tuple[str, bool, int, int]] = []
    opened: Counter = Counter()
    ends: dict[str, int] = {}
    aside = links = 0
    around = -1
    at = 0

    def text(raw: str) -> None:
        clean = html.unescape(raw)
        n = len(clean.split())
        kind = "aside" if aside else "linked" if links else "word"
        pieces.append(Piece(kind, clean, n, around >= 0 and not aside, around))

    def leave(count: int) -> None:
        nonlocal aside, links, around
        for _ in range(count):
            tag, starts, outer, _ = stack.pop()
            opened[tag] -= 1
            aside -= starts
            links -= tag == "a"
            if tag in ("article", "main"):
                found.span[around] = (found.span[around][0], len(pieces) - 1)
                around = outer

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag or (m["tag2"] and not m[0].endswith(">")):
            continue
        closing, attributes = (m["end"], m["attributes"]) if m["tag"] else (m["end2"], m["attributes2"])
        if not closing and tag in _END_OF:
            # Left out with all it holds if it is closed somewhere; where the last end tag stands is looked up once.
            if tag not in ends:
                ends[tag] = max((x.start() for x in _END_OF[tag].finditer(page, at)), default=-1)
            if at <= ends[tag]:
                at = _END_OF[tag].search(page, at).end()
                continue
        if closing:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                leave(len(stack) - depth)
        else:
            if tag in BLOCKS and opened["p"]:
                # A paragraph left open, with inline elements open inside, ends here.
                depth = stack[-1][3]
                if depth >= 0 and stack[depth][0] == "p":
                    leave(len(stack) - depth)
            if tag in _CLOSES and stack and stack[-1][0] in _CLOSES[tag]:
                leave(1)
        pieces.append(Piece(tag, "", 0, around >= 0 and not aside, around))
        if not closing and tag not in VOID and not attributes.rstrip().endswith("/"):
            starts = is_boilerplate(tag, attributes, around >= 0)
            stack.append((tag, starts, around, (stack[-1][3] if stack else -1) if tag in INLINE else len(stack)))
            opened[tag] += 1
            aside += starts
            links += tag == "a"
            if tag in ("article", "main"):
                found.outer[len(pieces) - 1], found.tag[len(pieces) - 1] = around, tag
                around = len(pieces) - 1
                found.span[around] = (around, around)
    if at < len(page):
        text(page[at:])
    leave(len(stack))
    return pieces, found


def class_of(piece: Piece) -> str:
    kind = piece.kind
    return kind if kind in DEFAULT_WEIGHTS or kind in BLOCKS or kind in INLINE else "other"


def count_classes(pages: list[str]) -> Counter:
    """(class, inside) -> tokens, over the pages that mark their content."""
    out: Counter = Counter()
    for page in pages:
        pieces, found = parse(page or "")
        if found.span:
            for p in pieces:
                out[class_of(p), p.content] += p.words if p.text else 1
    return out


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of being content, by class, against all tokens; words at least a little positive, everything
    else at least a little negative."""
    inside, outside = (sum(n for (_, c), n in counts.items() if c is side) + 1 for side in (True, False))
    if inside == 1:
        return DEFAULT_WEIGHTS
    out = dict(DEFAULT_WEIGHTS)
    for kind in {k for k, _ in counts}:
        odds = math.log((counts.get((kind, True), 0) + 1) / inside) - math.log((counts.get((kind, False), 0) + 1) / outside)
        out[kind] = max(odds, 0.2) if kind == "word" else min(odds, -0.05)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last of the contiguous run with the greatest sum; the earliest among equals, the shortest of
    those."""
    best, region, total, start = 0.0, (0, -1), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i)
    return region


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The main text: blocks joined by blank lines."""
    pieces, found = parse(page or "")
    other = weight["other"]
    first, last = best_region([weight.get(class_of(p), other) * (p.words if p.text else 1) for p in pieces])
    ranges = [(first, last)]
    article = {e: found.article(e) for e in found.span}
    held: Counter = Counter()
    for p in pieces[first : last + 1]:
        if p.element >= 0:
            held[article[p.element]] += p.words
    total = sum(p.words for p in pieces[first : last + 1])
    if held and sum(held.values()) * 2 > total:
        most = max(held.values())
        chosen = sorted(e for e, n in held.items() if 4 * n >= most)
        ranges = [found.span[e] for e in chosen]
        around = found.main(chosen[0])
        if around >= 0 and found.tag[chosen[0]] == "article":
            start, end = found.span[around]
            ranges = [(start, min(end, max(last, ranges[0][1])))] if len(ranges) == 1 else ranges
    blocks, line = [], []
    for p in (p for start, end in ranges for p in pieces[start : end + 1]):
        if p.text:
            if p.kind != "aside":
                line.append(p.text)
        elif p.kind == "br":
            line.append(" ")
        elif p.kind not in INLINE:
            blocks.append(" ".join("".join(line).split()))
            line = []
    blocks.append(" ".join("".join(line).split()))
    return "\n\n".join(b for b in blocks if b)


def fit_weights(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Weights counted over all pages; what reaches the driver is a row for each class of token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches):
            total += count_classes(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([c for _, c in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["kind", "inside", "n"])

    rows = pages.select(column).mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return weights({(r.kind, r.inside): r.n for r in rows})


def extract_text(pages: DataFrame, weight: dict[str, float] | None = None, column: str = "html") -> DataFrame:
    """pages without the HTML but with text and n_chars."""
    weight = weight or fit_weights(pages, column)
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(x, weight) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "text string, n_chars long"]))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
