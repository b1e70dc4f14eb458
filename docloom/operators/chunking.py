"""Splitters as column expressions: fixed windows and folds that pack pieces greedily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import bind, strip

SENTENCE_END = r"[。！？.!?]+[”\"』]?\s*"
SENTENCE = r"[^。！？.!?]*" + SENTENCE_END + r"|[^。！？.!?]+"
REFERENCE_START = r"\n\s*(?:\[[0-9]+\]|[0-9]+\.)\s+"
#: Labels of drug leaflets (fixed values).
DRUG_LABELS = "药品名称|通用名称|商品名称|性状|物理性质|鉴别|鉴定|检查|检验|含量测定|有效成分|功能与主治|适应症|用法用量|不良反应|禁忌|注意事项|贮藏|包装|有效期|批准文号|生产企业"
#: Whole lines that head the sections of a paper (fixed values).
ACADEMIC_HEADS = r"(?i)^\s*(摘要|ABSTRACT|Summary|关键词|KEYWORDS|Key\s+words|引言|INTRODUCTION|前言|绪论|方法|METHODOLOGY|实验方法|研究方法|结果|RESULTS|实验结果|讨论|DISCUSSION|分析与讨论|结论|CONCLUSION|总结|参考文献|REFERENCES|REFERENCE|致谢|ACKNOWLEDGEMENTS|附录|APPENDIX)\s*$"


def window_chunks(text: Column, size: int = 2200, overlap: int = 200) -> Column:
    """Windows of `size` characters every size - overlap, stripped, blank ones left out; a short text as it is."""
    if overlap >= size:
        raise ValueError("the overlap must be less than the size")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int"))
    windows = F.transform(starts, lambda i: strip(F.substring(text, i * step + 1, F.lit(size))))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.filter(windows, lambda x: x != ""))


def greedy_pack(pieces: Column, size: int, joiner: str, slack: int, opens: Column | None = None) -> Column:
    """Pieces joined as long as length + slack stays within size; a larger piece is a chunk of its own, and a piece for
    which `opens`, an array of booleans beside them, holds starts a chunk. The fold goes over lengths and gathers the
    places where chunks start; their texts are made once, afterwards."""

    def packed(p: Column) -> Column:
        sizes = F.transform(p, lambda x, i: F.struct(F.length(x).alias("n"), (F.lit(False) if opens is None else F.get(opens, i)).alias("open"), i.alias("i")))
        start = F.struct(F.lit(0).alias("cur"), F.array().cast("array<int>").alias("starts"))

        def step(a: Column, x: Column) -> Column:
            fits = (x["i"] > 0) & ~x["open"] & (a["cur"] + x["n"] + slack <= size)
            cur = F.when(fits, a["cur"] + x["n"] + len(joiner)).otherwise(x["n"])
            return F.struct(cur.alias("cur"), F.when(fits, a["starts"]).otherwise(F.array_append(a["starts"], x["i"])).alias("starts"))

        starts = F.aggregate(sizes, start, step, lambda a: a["starts"])
        return bind(starts, lambda s: F.transform(s, lambda at, k: F.array_join(F.slice(p, at + 1, F.coalesce(F.get(s, k + 1), F.size(p)) - at), joiner)))

    return bind(pieces, packed)


def _kept(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Sentences with their end marks; pieces without text go with their marks."""
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda x: strip(F.regexp_replace(x, SENTENCE_END, "")) != "")


def pack_sentences(text: Column, size: int = 500) -> Column:
    return greedy_pack(sentences(text), size, "", 0)


def pack_paragraphs(text: Column, size: int = 500) -> Column:
    """Paragraphs packed whole; one that is too large is packed by sentences, each of whose chunks starts a new one, and
    the last of them stays open. A large paragraph of marks alone closes the open chunk, which then goes on as a copy."""

    def of_paragraph(p: Column) -> Column:
        one = F.array(F.struct(p.alias("t"), F.lit(False).alias("open")))
        return F.when(F.length(p) <= size, one).otherwise(F.transform(pack_sentences(p, size), lambda x: F.struct(x.alias("t"), F.lit(True).alias("open"))))

    def packed(paragraphs: Column) -> Column:
        pieces = F.flatten(F.transform(paragraphs, of_paragraph))
        plain = bind(pieces, lambda x: greedy_pack(x["t"], size, "\n\n", 2, x["open"]))
        blank = F.exists(paragraphs, lambda p: (F.length(p) > size) & (F.size(sentences(p)) == 0))
        return F.when(blank, _pack_with_copies(paragraphs, size)).otherwise(plain)

    return bind(_kept(F.split(text, r"\n\s*\n")), packed)


def _pack_with_copies(paragraphs: Column, size: int) -> Column:
    """The fold of texts for the case of large paragraphs of marks alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["cur"]) + F.length(p) + 2 <= size
        closed = F.when(a["cur"] == "", a["done"]).otherwise(F.array_append(a["done"], a["cur"]))
        parts = pack_sentences(p, size)
        small = F.length(p) <= size
        done = F.when(fits, a["done"]).when(small, closed).otherwise(F.concat(closed, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))))
        cur = (
            F.when(fits & (a["cur"] == ""), p)
            .when(fits, F.concat(a["cur"], F.lit("\n\n"), p))
            .when(small, p)
            .otherwise(F.coalesce(F.try_element_at(parts, F.lit(-1)), a["cur"]))
        )
        return F.struct(done.alias("done"), cur.alias("cur"))

    return F.aggregate(paragraphs, start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.array_append(a["done"], a["cur"])))


def pack_words(text: Column, size: int = 500) -> Column:
    """White-space words, each counted with one space."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return greedy_pack(words, size, " ", 2)


def pack_lines(text: Column, size: int = 500) -> Column:
    """Stripped lines packed; a blank line closes the chunk."""
    blocks = F.split(F.array_join(F.transform(F.split(text, "\n"), strip), "\n"), r"\n{2,}")
    return F.flatten(F.transform(blocks, lambda b: greedy_pack(_kept(F.split(b, "\n")), size, "\n", 2)))


def pack_default(text: Column, size: int = 500) -> Column:
    """Lines as they are; the joining line feed isn't counted; chunks are stripped. The fold goes over lengths: a first line
    that fits counts with a line feed before it, and a chunk that is an empty line alone is none."""

    def packed(lines: Column) -> Column:
        sizes = F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i")))
        start = F.struct(F.lit(0).alias("cur"), F.array().cast("array<int>").alias("starts"))

        def named(a: Column) -> Column:
            return F.when(a["cur"] == 0, F.slice(a["starts"], 1, F.greatest(F.size(a["starts"]) - 1, F.lit(0)))).otherwise(a["starts"])

        def step(a: Column, x: Column) -> Column:
            fits = a["cur"] + x["n"] <= size
            starts = F.when(fits & (x["i"] > 0), a["starts"]).otherwise(F.array_append(named(a), x["i"]))
            return F.struct((F.when(fits, a["cur"] + 1).otherwise(0) + x["n"]).alias("cur"), starts.alias("starts"))

        starts = F.aggregate(sizes, start, step, named)
        return bind(starts, lambda s: F.transform(s, lambda at, k: strip(F.array_join(F.slice(lines, at + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - at), "\n"))))

    return bind(F.split(text, "\n"), packed)


def split_references(text: Column, size: int = 500, group: int = 5) -> Column:
    """Entries in groups of five, numbered anew in each; a group over size as single entries with their numbers."""
    items = _kept(F.split(text, REFERENCE_START))

    def of_group(g: Column) -> Column:
        part = F.slice(items, g * group + 1, group)
        joined = F.array_join(F.transform(part, lambda x, j: F.concat(F.lit("["), (j + 1).cast("string"), F.lit("] "), x)), "\n")
        single = F.transform(part, lambda x, j: F.concat(F.lit("["), (g * group + j + 1).cast("string"), F.lit("] "), x))
        return F.when(F.length(joined) > size, single).otherwise(F.array(joined))

    groups = F.when(F.size(items) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / group).cast("int")))
    return F.flatten(F.transform(groups, of_group))


def split_abstract(text: Column, size: int = 500) -> Column:
    """At `Abstract:` into what stands before and the rest; without it one chunk, cut at size."""
    at = F.locate("Abstract:", text)
    two = F.filter(F.array(strip(F.substring(text, F.lit(1), at - 1)), F.concat(F.lit("Abstract:"), strip(F.substring(text, at + 9, F.length(text))))), lambda x: x != "")
    return F.when(at > 0, two).otherwise(F.array(F.substring(text, 1, size)))


def split_drug(text: Column, size: int = 500) -> Column:
    """Labels lose their brackets and are packed like their bodies."""
    return greedy_pack(_kept(F.split(F.regexp_replace(text, "【(" + DRUG_LABELS + ")】", "\x01$1\x01"), "\x01")), size, "\n", 2)


def academic_sections(text: Column) -> Column:
    """Sections of a paper by heading lines, each under 【heading】; a heading without lines vanishes."""

    def cut(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(ACADEMIC_HEADS), i)), lambda i: i.isNotNull())

        def section(at: Column, end: Column) -> Column:
            body = F.array_join(F.slice(lines, at + 2, end - at - 1), "\n")
            title = F.regexp_extract(F.get(lines, at), ACADEMIC_HEADS, 1)
            return F.when(at < 0, body).otherwise(F.concat(F.lit("【"), title, F.lit("】\n"), body))

        def sections(starts: Column) -> Column:
            spans = F.transform(starts, lambda at, k: F.struct(at.alias("at"), F.coalesce(F.get(starts, k + 1), F.size(lines)).alias("end")))
            return F.transform(F.filter(spans, lambda s: s["end"] - s["at"] > 1), lambda s: section(s["at"], s["end"]))

        return bind(F.concat(F.array(F.lit(-1)), heads), sections)

    return bind(_kept(F.split(text, "\n")), cut)


def split_academic_lines(text: Column, size: int = 500) -> Column:
    def packed(sections: Column) -> Column:
        parts = F.flatten(F.transform(sections, lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(pack_lines(s, size))))
        return F.when(F.size(sections) == 0, pack_lines(text, size)).otherwise(parts)

    return bind(academic_sections(text), packed)


def explode_chunks(df: DataFrame, chunks: Column, *keys: str) -> DataFrame:
    """keys, chunk_index (from 0) and chunk."""
    return df.select(*keys, F.posexplode(chunks).alias("chunk_index", "chunk"))


def chunk_scale(docs: DataFrame, text: str = "text", size: int = 500, overlap: int = 50, most: int = 5000) -> DataFrame:
    """One row: the estimated chunks of all texts and the size and overlap that keep them near `most`."""
    base = docs.where(strip(F.col(text)) != "").agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
    est = F.greatest(F.lit(1), F.floor(F.col("chars") / size)).cast("long")
    scale = F.least(F.lit(3.0), est / F.lit(float(most)))
    new_size = F.when(est > most, F.floor(size * scale)).otherwise(size).cast("long")
    return base.select(
        est.alias("est_chunks"), new_size.alias("chunk_size"), F.when(est > most, F.least(F.floor(overlap / scale), F.floor(new_size / 3))).otherwise(overlap).cast("long").alias("chunk_overlap")
    )
