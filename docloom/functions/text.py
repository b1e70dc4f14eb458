"""Column functions over texts: normalising, masking, abstracting, trimming, prompts. All but page cleaning are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions.html import visible_text_of

#: Masks in the order in which they apply (fixed values).
MASKS = (
    (r"\b\d{11}\b", "[PHONE]"),
    (r"\b\d{17}[0-9Xx]\b", "[ID]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", "[DATE]"),
    (r"\b\d{1,2}[:：]\d{2}\b", "[TIME]"),
    (r"\b\d{6,}\b", "[NUMBER]"),
)
#: Words that an abstracted question leaves out (fixed values).
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are")
#: The beginning of an abstracted question (fixed value).
ABSTRACT_PREFIX = "intent:patient_education; key_terms:"
#: The wording of prompts (fixed values).
PROMPT_HEAD = "You are an AI system for patient education.\nWrite clearly and concisely for middle-aged and older adults.\nKeep the answer within {max_words} words.\nIf evidence is insufficient, say so and advise discussing with the physician.\n\nClinical context (system-fixed):\n{context}\n\nEvidence:\n"
PROMPT_QUESTION = "\n\nPatient question:\n"
EVIDENCE_LINES = 20
#: The most characters of an external item's fields (fixed values).
FIELD_LIMITS = {"title": 200, "url": 500, "text": 4000}


def strip(text: Column) -> Column:
    """Without white space at both ends, of any ASCII kind."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\f"))


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once: it is bound to a lambda variable, which is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text: Column) -> Column:
    """Line ends to LF, runs of blank lines cut, words joined over line-end hyphens, white space before LF gone,
    ends stripped. The fourth step takes every blank line, as white space before a line end includes line ends."""
    out = F.replace(text, F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    return strip(F.regexp_replace(out, r"\s+\n", "\n"))


def deidentify(text: Column) -> Column:
    """Masks applied one after the other; word boundaries know all letters, digits are ASCII."""
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, r"(?U)" + pattern.replace(r"\d", "[0-9]"), mask.replace("[", r"\[").replace("]", r"\]"))
    return text


def abstract_query(text: Column, words: int = 18, chars: int = 500) -> Column:
    """What leaves the engine of a question: up to `words` ASCII words of its first `chars` characters."""
    flat = F.lower(F.substring(strip(F.regexp_replace(text, r"\s+", " ")), 1, chars))
    kept = F.filter(F.regexp_extract_all(flat, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    return F.concat(F.lit(ABSTRACT_PREFIX), F.array_join(F.slice(kept, 1, words), " "))


def trim_to_words(text: Column, n: int) -> Column:
    words = F.split(strip(text), r"\s+")
    return F.when(F.size(words) <= n, strip(text)).otherwise(F.array_join(F.slice(words, 1, n), " "))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def nonspace_ratio(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, r"\s", "")) / F.length(text))


def doi(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+", 0)
    return F.when(found != "", found)


def title(text: Column) -> Column:
    """The first line with `guideline` and over 20 characters, else the first longest line over 20 characters
    without `et al`, else null."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) > 20)
    named = F.get(F.filter(lines, lambda x: F.lower(x).contains("guideline")), F.lit(0))
    others = F.filter(lines, lambda x: ~F.lower(x).contains("et al"))
    longest = F.array_max(F.transform(others, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("line"))))
    return F.coalesce(named, longest["line"])


def clean_html(html: Column) -> Column:
    """Text lines of a page, dropped elements and markup left out, character references decoded."""
    return visible_text_of(html)


def truncated(field: str, value: Column) -> Column:
    return F.substring(value, 1, FIELD_LIMITS[field])


def local_line(source: Column, year: Column, text: Column) -> Column:
    return F.concat(F.lit("[LOCAL:"), F.coalesce(source, F.lit("")), F.lit(":"), F.coalesce(year.cast("string"), F.lit("NA")), F.lit("] "), F.coalesce(text, F.lit("")))


def external_line(url: Column, text: Column) -> Column:
    return F.concat(F.lit("[EXT:"), F.coalesce(url, F.lit("")), F.lit("] "), F.coalesce(text, F.lit("")))


def prompt(lines: Column, question: Column, config: EngineConfig | None = None) -> Column:
    """The prompt of an ordered array of evidence lines and a question."""
    config = config or EngineConfig()
    head = PROMPT_HEAD.format(max_words=config.max_words, context=config.context)
    return strip(F.concat(F.lit(head), F.array_join(F.slice(lines, 1, EVIDENCE_LINES), "\n"), F.lit(PROMPT_QUESTION), question))
