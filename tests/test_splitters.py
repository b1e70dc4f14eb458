import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import splitters

TEXT = st.text(alphabet="ab .\n,。", max_size=200)


@given(TEXT, st.integers(5, 40), st.integers(0, 5))
def test_recursive_bounds_and_cover(text, size, overlap):
    assert all(0 < len(c) <= size and c in text for c in splitters.recursive_chunks(text, size, overlap))
    assert "".join("".join(splitters.recursive_chunks(text, size, 0)).split()) == "".join(text.split())


@given(TEXT, st.integers(6, 40), st.integers(0, 5))
def test_length_chunks_cover(text, size, overlap):
    assert "".join("".join(splitters.length_chunks(text, size, 0)).split()) == "".join(text.split())
    assert all(len(c) <= size + splitters.LOOK_AHEAD for c in splitters.length_chunks(text, size, overlap))


def merged(pieces, size, overlap):
    """The contract of merging, piece by piece."""
    out, held = [], []
    for p in pieces:
        if held and sum(map(len, held)) + len(p) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                held = held[1:]
        held = [*held, p]
    return [*out, "".join(held)] if held else out


def brute_recursive(text, size, overlap, marks):
    mark = next((m for m in marks if m in text), marks[-1])
    finer = marks[marks.index(mark) + 1 :]
    pieces = list(text) if not mark else [x for x in (("" if i == 0 else mark) + p for i, p in enumerate(text.split(mark))) if x]
    out, small = [], []
    for p in pieces:
        if len(p) < size or (len(p) == size and not finer):
            small.append(p)
            continue
        out += merged(small, size, overlap)
        small = []
        out += [p] if len(p) == size or not finer else brute_recursive(p, size, overlap, finer)
    return out + merged(small, size, overlap)


@given(TEXT, st.integers(2, 40), st.integers(0, 20), st.sampled_from([splitters.SEPARATORS, splitters.SEPARATORS_PLAIN]))
def test_recursive_against_brute_force(text, size, overlap, marks):
    overlap = min(overlap, size)
    want = [c.strip() for c in brute_recursive(text, size, overlap, marks) if c.strip()]
    assert splitters.recursive_chunks(text, size, overlap, marks) == want


def test_recursive_whole_and_errors():
    assert splitters.recursive_chunks("a" * 10, 10, 0) == ["a" * 10]
    with pytest.raises(ValueError):
        splitters.recursive_chunks("a", 5, 6)
    with pytest.raises(ValueError):
        splitters.length_chunks("a", 5, 5)


def test_sentences_and_overlap():
    text = "First one here is long. Second one here is long. Third one here is long. tail"
    chunks = splitters.sentence_chunks(text, 30, 10)
    assert chunks[:2] == ["First one here is long.", "Second one here is long."] and "tail" not in chunks[-1]
    assert "tail" in splitters.sentence_chunks(text, 30, 10, keep_tail=True)[-1]
    assert splitters.tail_overlap("short", 5) == "" and splitters.tail_overlap("x" * 30, 0) == ""
    assert splitters.sentence_chunks("A 3.5 b. C.", 100, 0) == ["A 3. 5 b. C."]


def test_overlap_by_hand():
    assert splitters.tail_overlap("Some words here. And a tail of it", 10) == "And a tail of it"
    assert splitters.tail_overlap("no end of a sentence in it, at all here", 9) == "all here"
    assert splitters.tail_overlap("x" * 30 + ", word", 5) == "word"
    sentences = [f"Sentence {k} is here." for k in range(6)]
    chunks = splitters.sentence_chunks(" ".join(sentences), 45, 12)
    assert chunks[:2] == [" ".join(sentences[:2]), " ".join(sentences[2:4])]
    assert chunks[2] == splitters.tail_overlap(chunks[0], 12) + " " + sentences[4]


def test_paragraphs_by_hand():
    assert splitters.paragraph_chunks("aa\n\nbb\n \ncc", 6) == ["aa\n\nbb", "cc"]
    assert splitters.paragraph_chunks("aa\n\nOne. Two. Three.\n\nx", 10) == ["aa", "One. Two. ", "Three.\n\nx"]
    assert splitters.paragraph_chunks("... One. !! Two", 5) == ["One. ", "Two"] and splitters.paragraph_chunks("", 5) == []


def test_large_documents():
    assert splitters.large_document_chunks("word " * 10, limit=100) == ["word " * 10]
    text = " ".join(f"Sentence {k} of it." for k in range(60))
    assert splitters.large_document_chunks(text, limit=200) == splitters.recursive_chunks(text, 500, 100, splitters.SEPARATORS_PLAIN)
    packed = splitters.large_document_chunks(text, limit=20, size=400, overlap=0)
    assert all(len(c) // 4 <= 24 for c in packed) and len(packed) > 10 and "Sentence 59" in packed[-1]


def test_main_content_and_parts():
    text = "pre\n1 Intro\nbody\n2 Next\nmore"
    assert splitters.main_content(text) == ["1 Intro\nbody", "2 Next\nmore"]
    assert splitters.main_content(text, keep_preamble=True)[0] == "pre"
    parts = splitters.academic_parts("Title\nAbstract: words Keywords: k\n1 Intro\nbody\nReferences\n[1] a")
    assert [p for p, _ in parts] == ["title_author_info", "abstract", "main_content", "references"]


def test_titled():
    assert splitters.textbook_chunks("a\n第一章 x\nb") == ["a", "第一章 x\nb"]
    assert splitters.novel_chunks("a 第一章 x\nb") == ["a\n第一章 x\nb"]
    assert splitters.manual_chunks("a Step 1: go\nb") == ["a", "Step 1: go\nb"]
    assert splitters.novel_chunks("a\n***\nb\n尾声\nc") == ["a\n***\nb\n尾声\nc"]  # a rule inside a piece isn't one of its own
    assert splitters.novel_chunks("人物***尾声\nc") == ["人物", "***", "尾声\nc"]
    assert splitters.textbook_chunks("本章小结" + "x" * 600 + "\n思考题y", 500) == ["本章小结", "x" * 600, "思考题\ny"]


def test_references_by_hand():
    items = "".join(f"\n[{k}] item {k}" for k in range(1, 8))
    assert list(splitters.reference_groups("References" + items, 500)) == ["\n".join(f"[{j}] {x}" for j, x in enumerate(g, 1)) for g in (["References", "item 1", "item 2", "item 3", "item 4"], ["item 5", "item 6", "item 7"])]
    assert list(splitters.reference_groups(items, 20))[-2:] == ["[6] item 6", "[7] item 7"]
    assert splitters.abstract_chunks("摘要：a Abstract: b", 500) == ["摘要：a", "Abstract:b"] and splitters.abstract_chunks("摘要" * 9, 4) == ["摘要摘要"]
    chunks = splitters.academic_chunks("T\n摘要：zh 关键词：k Abstract: en Keywords: k 1 Intro\nbody\nReferences\n[1] a")
    assert chunks == [("title_author_info", "T\n"), ("abstract", "摘要：zh "), ("abstract", "Abstract:en"), ("main_content", "1 Intro\nbody"), ("references", "[1] References\n[2] a")]


def test_udtf(spark):
    splitters.register_chunks_udtf(spark)
    rows = spark.sql("SELECT chunk_index, chunk FROM VALUES ('aa bb cc') AS t(x), LATERAL chunks(x, 5, 0)").collect()
    assert [r.chunk for r in rows] == ["aa bb", "cc"]


def test_texts_are_split_in_slices(spark):
    """However many texts a batch has, chunks of a slice of them are held at a time; each text keeps its own chunks."""
    held = splitters.chunks_udf(lambda t: [t] * 2).func([pa.array(["a"] * 600 + [None] * 3)].__iter__())
    parts = list(held)
    assert max(len(p) for p in parts) <= 256 and sum(len(p) for p in parts) == 603
    assert parts[-1].to_pylist()[-4:] == [["a", "a"], [], [], []]
    rows = spark.range(1000, numPartitions=1).select("id", splitters.chunks_udf(lambda t: [t, t + "!"])(F.col("id").cast("string")).alias("c")).collect()
    assert all(r.c == [str(r.id), f"{r.id}!"] for r in rows) and len(rows) == 1000
