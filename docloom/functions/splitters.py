"""Splitters whose steps depend on what they cut before: plain functions, run over Arrow batches.

All work on positions. A splitter finds where a text may be cut, keeps running totals of the lengths between,
looks up by bisection how far each chunk reaches, and takes the chunks' texts out once at the end; so the work grows
with the number of cuts and chunks, not with the square of a chunk's pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby, pairwise

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: So many texts of an Arrow batch are split at a time, which bounds what a worker holds beside the batch.
SLICE_ROWS = 256
#: Separators from coarse to fine (fixed values).
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", "；", "; ", "，", ", ", " ", "")
SEPARATORS_PLAIN = ("\n\n", "\n", ". ", " ", "")
#: Heading patterns of the book splitters (fixed values).
TEXTBOOK = (
    r"第[一二三四五六七八九十百千万]+章\s*[^\n]*", r"\d+\.\d+(?:\.\d+)*\s+[^\n]*", r"小节\s*[^\n]*", r"习题\s*\d+[^\n]*",
    r"练习题\s*\d+[^\n]*", r"例题\s*\d+[^\n]*", r"本章小结|小结|本章要点", r"思考题|复习题|讨论题",
)
NOVEL = (
    r"第[一二三四五六七八九十百千万]+章\s*[^\n]*", r"第[一二三四五六七八九十百千万]+回\s*[^\n]*", r"人物|角色|主要人物|登场人物",
    r"场景|地点|时间|背景", r"序幕|楔子|引子|开场白", r"尾声|结局|结尾|后记",
)
MANUAL = (
    r"\d+\.\s+[^\n]+", r"Step\s+\d+\s*[:：]?\s*[^\n]*", r"注意事项|注意|警告|WARNING|CAUTION", r"提示|技巧|小贴士|TIP|HINT",
    r"步骤|操作步骤|使用方法", r"示例|例子|示例代码|EXAMPLE", r"故障排除|问题解决|FAQ|常见问题",
)
REFERENCE_BOOK = (
    r"[A-Z][A-Za-z]+\s*[:：]", r"\d+\.\s+定义|Definition\s+\d+", r"\d+\.\s+定理|Theorem\s+\d+", r"\d+\.\s+示例|Example\s+\d+",
    r"\d+\.\s+练习|Exercise\s+\d+", r"参考文献|参考书目|References",
)
#: Where sentences end, where lengths may be cut, where chapters and paragraphs start (fixed values).
LOOK_AHEAD, GROUP = 100, 5
BREAK = re.compile(r"[ 。！？,，;；\n\t]")
END = re.compile(r"[。！？.!?]\s*")
LEADING = re.compile(r"[,，;；.。!！?？]\s*")
SENTENCE = re.compile(r"[。！？.?!]+[」》”\"]?\s*")
CHAPTER = re.compile(r"\n(?:\d+(?:\.\d+)*)\s+[^\n]+")
PARAGRAPH, SENTENCE_RUN = re.compile(r"\n\s*\n"), re.compile(r"[。！？.!?]+[”\"』]?\s*")
REFERENCE = re.compile(r"\n\s*(?:\[\d+\]|\d+\.)\s+")
RULE = re.compile(r"[*\-]{3,}")


def runs(lengths: list[int], size: int, joint: int, slack: int, opens: set[int] = frozenset()) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs into which pieces are packed: as many as fit, one at least. A joint adds `joint` to a
    run's length, but the piece to come counts `slack`; pieces at `opens` always start a run."""
    total = [0, *accumulate(n + joint for n in lengths)]
    borders = sorted({*opens, len(lengths)})
    at = 0
    while at < len(lengths):
        fit = bisect_right(total, total[at] + size + 2 * joint - slack) - 1
        end = min(max(fit, at + 1), borders[bisect_right(borders, at)])
        yield at, end
        at = end


def stripped(text: str, cuts: list[int]) -> list[str]:
    """What lies between neighbouring cuts, stripped, blanks left out."""
    return [x for a, b in pairwise(cuts) if (x := text[a:b].strip())]


def recursive_spans(text: str, low: int, high: int, size: int, overlap: int, marks: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Spans of text[low:high]. It is cut before each place of the first mark it has. A span of small pieces holds as
    many as fit; the next one starts as far back as overlap and its first new piece allow. A large piece is a span
    of its own, cut by the marks that follow."""
    mark, *finer = next(marks[i:] for i, m in enumerate(marks) if not m or i + 1 == len(marks) or text.find(m, low, high) >= 0)
    inner = (m.start() for m in re.compile(re.escape(mark)).finditer(text, low, high)) if mark else range(low, high)
    cuts = [low, *(p for p in inner if low < p < high), high]
    limit = size if finer else size + 1
    for small, group in groupby(range(len(cuts) - 1), lambda i: cuts[i + 1] - cuts[i] < limit):
        numbers = list(group)
        if not small:
            for a, b in ((cuts[i], cuts[i + 1]) for i in numbers):
                yield from [(a, b)] if b - a == size or not finer else recursive_spans(text, a, b, size, overlap, tuple(finer))
            continue
        at, last = numbers[0], numbers[-1] + 1
        while True:
            end = bisect_right(cuts, cuts[at] + size, at, last + 1) - 1
            yield cuts[at], cuts[end]
            if end == last:
                break
            back = min(overlap, size - (cuts[end + 1] - cuts[end]))
            at = bisect_left(cuts, cuts[end] - back, at, end)


def recursive_chunks(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the first separator the text has, kept at the start of the next piece; small pieces are merged up to
    size and carry up to overlap over; larger ones go on to the finer separators."""
    if overlap > size:
        raise ValueError("the overlap must not exceed the size")
    spans = recursive_spans(text, 0, len(text), size, overlap, separators) if text else ()
    return [x for a, b in spans if (x := text[a:b].strip())]


def tail_overlap(previous: str, overlap: int) -> str:
    """What the next chunk repeats of the one before: what follows its last sentence end that leaves enough, else
    its last characters without a leading mark."""
    if overlap <= 0 or len(previous) < 20:
        return ""
    target, end = min(overlap, len(previous) // 3), len(previous.rstrip())
    starts = [min(m.end(), end) for m in END.finditer(previous, max(0, len(previous) - target - LOOK_AHEAD) + 1)]
    if k := bisect_right(starts, end - target // 2):
        return previous[starts[k - 1] : end]
    rest = previous[-target:].strip()
    mark = LEADING.match(rest)
    return rest[mark.end() :] if mark else rest


def length_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Windows that run on to the next break within a hundred characters."""
    if overlap >= size:
        raise ValueError("the overlap must be less than the size")
    breaks = [m.start() for m in BREAK.finditer(text)]
    out, at = [], 0
    while at < len(text):
        end = at + size
        k = bisect_left(breaks, end)
        if k < len(breaks) and breaks[k] < end + LOOK_AHEAD:
            end = breaks[k] + 1
        out.append(text[at:end].strip())
        at = end - max(overlap, 0)
    return [x for x in out if x]


def sentence_chunks(text: str, size: int, overlap: int, keep_tail: bool = False) -> list[str]:
    """Sentences packed with spaces; from the third on a chunk starts with the tail of the chunk before the last.
    Text after the last sentence end is left out unless keep_tail."""
    found = stripped(text, [0, *(m.end() for m in SENTENCE.finditer(text)), *([len(text)] if keep_tail else [])])
    if len(found) <= 1:
        return length_chunks(text, size, overlap)
    total = [0, *accumulate(len(x) + 1 for x in found)]
    out: list[str] = []
    at = 0
    while at < len(found):
        lead = [x for x in (tail_overlap(y, overlap) for y in out[-2:-1]) if x]
        room = size + 1 - sum(len(x) + 1 for x in lead)
        end = max(at + 1, bisect_right(total, total[at] + room) - 1)
        out.append(" ".join(lead + found[at:end]))
        at = end
    return out


def whole_sentences(text: str) -> list[str]:
    """Sentences with their marks as they stand; marks without a sentence before them go."""
    ends = [m.span() for m in SENTENCE_RUN.finditer(text)]
    starts = [0, *(b for _, b in ends)]
    return [text[a:b] for a, (c, b) in zip(starts, [*ends, (len(text), len(text))], strict=True) if text[a:c].strip()]


def paragraph_chunks(text: str, size: int) -> list[str]:
    """Paragraphs packed whole; one that is too large is packed by sentences, and its last chunk stays open."""
    pieces: list[str] = []
    opens: set[int] = set()
    for p in (x for x in (y.strip() for y in PARAGRAPH.split(text)) if x):
        if len(p) <= size:
            pieces.append(p)
            continue
        sentences = whole_sentences(p)
        parts = ["".join(sentences[a:b]) for a, b in runs([len(x) for x in sentences], size, 0, 0)]
        opens.update(range(len(pieces), len(pieces) + len(parts)))
        pieces += parts
    return ["\n\n".join(pieces[a:b]) for a, b in runs([len(x) for x in pieces], size, 2, 2, opens)]


def main_content(text: str, size: int = 500, overlap: int = 50, keep_preamble: bool = False) -> list[str]:
    """By numbered chapter headings if there are two or more (what stands before the first goes unless
    keep_preamble), else by paragraphs."""
    heads = [m.start() for m in CHAPTER.finditer(text)]
    if len(heads) < 2:
        return paragraph_chunks(text, size)
    out: list[str] = paragraph_chunks(text[: heads[0]], size) if keep_preamble else []
    for chapter in stripped(text, [*heads, len(text)]):
        out += sentence_chunks(chapter, size, overlap) if len(chapter) > size else [chapter]
    return out


#: Borders of a paper's parts (fixed values).
ABSTRACT_ZH = re.compile(r"(摘要[：:].*?)(?=关键词|中图分类号|1\s|引言|Key words|Keywords|Introduction)", re.S)
KEYWORDS_ZH = re.compile(r"关键词[：:].*?(?=中图分类号|Abstract|1\s|引言|Introduction)", re.S)
ABSTRACT_EN = re.compile(r"(Abstract:.*?)(?=Key words|Keywords|1\s|引言|Introduction)", re.S | re.I)
KEYWORDS_EN = re.compile(r"(?:Key words:.*?|Keywords:.*?)(?=1\s|引言|Introduction)", re.S | re.I)
REFERENCES = re.compile(r"参考文献|References|Reference")


def academic_parts(text: str) -> list[tuple[str, str]]:
    """(part, text) of a paper. What an unanchored search skips is lost, and keywords are left out."""
    m = re.search(r"摘要[：:]|Abstract:", text)
    at = m.start() if m else min(500, len(text))
    parts = [("title_author_info", text[:at])]
    for pattern, kept in ((ABSTRACT_ZH, True), (KEYWORDS_ZH, False), (ABSTRACT_EN, True), (KEYWORDS_EN, False)):
        if m := pattern.search(text, at):
            at = m.end()
            parts += [("abstract", m[1])] if kept else []
    m = REFERENCES.search(text, at)
    parts.append(("main_content", text[at : m.start() if m else len(text)]))
    return [*parts, ("references", text[m.start() :])] if m else parts


def abstract_chunks(text: str, size: int) -> list[str]:
    """At `Abstract:` into both languages; else one chunk, cut at size."""
    before, mark, after = text.partition("Abstract:")
    return [x for x in (before.strip(), mark + after.strip()) if x] if mark else [text[:size]]


def reference_groups(text: str, size: int) -> Iterator[str]:
    """Entries in groups of five, numbered anew in each; a group over size as single entries with their numbers."""
    items = [x for x in (y.strip() for y in REFERENCE.split(text)) if x]
    for first, group in groupby(enumerate(items), lambda x: x[0] - x[0] % GROUP):
        numbers, entries = zip(*group, strict=True)
        joined = "\n".join(f"[{n - first + 1}] {x}" for n, x in zip(numbers, entries, strict=True))
        yield from [joined] if len(joined) <= size else (f"[{n + 1}] {x}" for n, x in zip(numbers, entries, strict=True))


def academic_chunks(text: str, size: int = 500, overlap: int = 50) -> list[tuple[str, str]]:
    """(part, chunk): title whole, abstracts by language, main text by chapters, references by fives."""
    splitters: dict[str, Callable[[str], list[str]]] = {
        "abstract": lambda x: abstract_chunks(x, size),
        "main_content": lambda x: main_content(x, size, overlap),
        "references": lambda x: list(reference_groups(x, size)),
    }
    return [(part, chunk) for part, body in academic_parts(text) for chunk in splitters.get(part, lambda x: [x])(body)]


def titled_chunks(text: str, size: int, patterns: tuple[str, ...], breaks: bool) -> list[str]:
    """Pieces between and of headings, packed with line feeds. breaks: a heading opens a chunk. Otherwise only a
    line of stars or dashes does, and stands alone."""
    heads = re.compile("|".join(patterns))
    pieces = stripped(text, [0, *(p for m in heads.finditer(text) for p in m.span()), len(text)])
    if breaks:
        opens = {i for i, x in enumerate(pieces) if heads.match(x)}
    else:
        opens = {j for i, x in enumerate(pieces) if RULE.fullmatch(x) for j in (i, i + 1)}
    return ["\n".join(pieces[a:b]) for a, b in runs([len(x) for x in pieces], size, 1, 2, opens)]


def textbook_chunks(text: str, size: int = 500) -> list[str]:
    return titled_chunks(text, size, TEXTBOOK, True)


def novel_chunks(text: str, size: int = 500) -> list[str]:
    return titled_chunks(text, size, NOVEL, False)


def manual_chunks(text: str, size: int = 500) -> list[str]:
    return titled_chunks(text, size, MANUAL, True)


def reference_chunks(text: str, size: int = 500) -> list[str]:
    return titled_chunks(text, size, REFERENCE_BOOK, True)


def large_document_chunks(text: str, limit: int = 250_000, size: int = 500, overlap: int = 100) -> list[str]:
    """Within the token limit the text itself; over it chunks of size with overlap. A chunk that is still over the
    limit is packed by its sentences, counted in tokens (four characters each)."""
    if len(text) // 4 <= limit:
        return [text]
    out: list[str] = []
    for chunk in recursive_chunks(text, size, overlap, SEPARATORS_PLAIN):
        if len(chunk) // 4 <= limit:
            out.append(chunk)
        else:
            parts = chunk.split(". ")
            out += [". ".join(parts[a:b]) for a, b in runs([len(x) // 4 for x in parts], limit, 0, 0)]
    return out


def chunks_udf(function: Callable[..., list[str]], **options) -> Callable[[Column], Column]:
    """A splitter as an Arrow-batched column function; in slices; a null text has no chunks."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, max(len(batch), 1), SLICE_ROWS):
                texts = batch.slice(at, SLICE_ROWS).to_pylist()
                yield pa.array([[] if t is None else function(t, **options) for t in texts], pa.list_(pa.string()))

    return run


def register_chunks_udtf(spark: SparkSession, name: str = "chunks") -> None:
    """LATERAL chunks(text, size, overlap) in SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index int, chunk string")
    class Chunks:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(recursive_chunks(text or "", size, overlap))

    spark.udtf.register(name, Chunks)
