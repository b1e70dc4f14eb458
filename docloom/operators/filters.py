"""Filters on chunks."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import bind, strip

#: Characters that count as punctuation, besides ASCII's and white space (fixed values).
WIDE_PUNCTUATION = "，。！？；：「」『』（）【】《》〈〉、·"
PUNCTUATION = WIDE_PUNCTUATION + string.punctuation + " \t\n\r"
VALID_CLASS = "[一-鿿a-zA-Z0-9]"
#: Chunks that hold one of these say nothing (fixed values).
PLACEHOLDERS = (
    "待补充", "暂无", "暂无内容", "内容待补充",
    "NULL", "null", "None", "none",
    "空", "空白", "无内容", "无",
    "待更新", "更新中", "建设中",
    "To be added", "TBD", "TODO", "待办",
)
MIN_CHARS, MAX_PUNCTUATION, MIN_VALID = 15, 0.8, 0.3


def keep_chunk(chunk: Column) -> Column:
    """Long enough, not mostly punctuation, enough letters or digits, no placeholder (as a substring, any case). Stripped and
    lowered once; cheap tests come first."""

    def judged(text: Column) -> Column:
        n = F.length(text)
        # Characters that stay once punctuation is taken out.
        rest = F.length(F.translate(text, PUNCTUATION, ""))
        valid = n - F.length(F.regexp_replace(text, VALID_CLASS + "+", ""))
        words = sorted({p.lower() for p in PLACEHOLDERS})
        said = bind(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in words]))
        return (n >= MIN_CHARS) & (F.lit(1) - rest / n <= MAX_PUNCTUATION) & ~said & (valid / n >= MIN_VALID)

    return bind(strip(chunk), judged)


def drop_contained(chunks: Column) -> Column:
    """Of a chunk and the last kept one, where one holds the other, the longer stays. The fold keeps places and the last
    text alone; the texts kept are taken out at the end."""

    def folded(c: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(None).cast("string").alias("last"))

        def step(a: Column, x: Column) -> Column:
            linked = F.coalesce(a["last"].contains(x["t"]) | x["t"].contains(a["last"]), F.lit(False))
            instead = linked & (F.length(x["t"]) > F.length(a["last"]))
            kept = F.when(~linked, F.array_append(a["kept"], x["i"])).when(instead, F.array_append(F.slice(a["kept"], 1, F.size(a["kept"]) - 1), x["i"])).otherwise(a["kept"])
            return F.struct(kept.alias("kept"), F.when(~linked | instead, x["t"]).otherwise(a["last"]).alias("last"))

        placed = F.transform(c, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        return F.transform(F.aggregate(placed, start, step, lambda a: a["kept"]), lambda i: F.get(c, i))

    return bind(chunks, folded)


def filter_chunks(chunks: Column) -> Column:
    """All rules on a document's ordered chunks; chunks come out stripped."""
    return drop_contained(F.transform(F.filter(chunks, keep_chunk), strip))


def keep_simple(chunk: Column) -> Column:
    """20 characters, 3 words and something alphanumeric."""
    text = strip(chunk)
    return (F.length(text) >= 20) & (F.size(F.split(text, r"\s+")) >= 3) & text.rlike(r"[\p{L}\p{N}]")


def drop_blank(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(strip(F.col(text)) != "")


def alive(evidence: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Evidence that hasn't expired; at the very moment of expiry it still lives."""
    return evidence.where(now <= F.col(expires))
