"""Operator 7, quality rules: a threshold table compiled into one projection of built-in functions.

Cases: a null text counts as empty and fails; repeated rows are judged each on their own; texts of any length are
measured whole; other columns pass through and may have any name but those of the measures, __m, base_failed and kept,
which are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, read_table

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus; a text of prose has some of them.
STOP_WORDS = (
    "the of and to in that is for with was as it on be at by this from or an are "
    "le la les de des et en que un une dans pour qui est sur pas au du par avec "
    "der die das und den von zu mit sich ein eine nicht auf ist dem als im auch "
    "el los las y del se una por con para no su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails when measure lies outside [low, high]."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Every measure is a column of measures().
RULES = (
    Rule("mean_word_length", "mean_word_chars", 1.5, 20.0),
    Rule("symbols_to_words", "symbol_ratio", None, 0.25),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("capitals", "upper_ratio", None, 0.5),
    Rule("exclamations", "bang_ratio", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Up to so many repeated hashes are looked up one by one; it decides speed alone, never the result.
FEW = 64


def _removed(text: Column, pattern: str) -> Column:
    """How many characters matches of pattern make up."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words lying in a three-word window that the text holds twice or more.

    Equal windows have equal hashes, so windows with a hash of their own are left aside first; where few
    hashes repeat only their windows go on, else all do. Those are compared as text: each carries its
    position behind a tab (no word has one), so that equal windows are neighbours once sorted."""

    def candidates(hashes: Column) -> Column:
        repeated = let(F.sort_array(hashes), lambda z: F.array_distinct(F.filter(z, lambda x, i: x == F.get(z, i + 1))))
        every = F.sequence(F.lit(0), n - 3)
        return let(
            repeated,
            lambda d: F.when(F.size(d) == 0, F.array().cast("array<int>"))
            .when(F.size(d) <= FEW, F.filter(every, lambda i: F.array_contains(d, F.get(hashes, i))))
            .otherwise(every),
        )

    def positions(tagged: Column) -> Column:
        return let(
            tagged,
            lambda s: let(
                F.transform(s, lambda x: F.substring_index(x, "\t", 1)),
                lambda keys: F.filter(
                    F.transform(
                        s,
                        lambda x, i: F.when(
                            (F.get(keys, i) == F.get(keys, i - 1)) | (F.get(keys, i) == F.get(keys, i + 1)),
                            F.substring_index(x, "\t", -1).cast("int"),
                        ),
                    ),
                    lambda p: p.isNotNull(),
                ),
            ),
        )

    def tagged(w: Column, at: Column) -> Column:
        return F.transform(at, lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1), F.lit(" "), F.get(w, i + 2), F.lit("\t"), i.cast("string")))

    hashes = F.transform(F.slice(words, 1, n - 2), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    at = let(hashes, candidates)
    covered = F.size(F.array_distinct(F.flatten(F.transform(positions(F.sort_array(tagged(words, at))), lambda p: F.array(p, p + 1, p + 2)))))
    return F.when(n < 3, F.lit(0)).otherwise(covered)


def measures(text: Column) -> Column:
    """A struct of all measures of a text, from built-in functions alone."""
    text = F.coalesce(text, F.lit(""))

    def of_words(t: Column, words: Column, lines: Column, counts: Column) -> Column:
        n = F.size(words)
        per_word = F.greatest(n, F.lit(1))
        return F.struct(
            n.cast("long").alias("n_words"),
            counts["chars"].cast("long").alias("word_chars"),
            counts["symbols"].cast("long").alias("n_symbols"),
            counts["dup_lines"].cast("long").alias("n_dup_lines"),
            _repeat_words(words, n).cast("long").alias("n_repeat_words"),
            (counts["chars"] / per_word).alias("mean_word_chars"),
            (counts["symbols"] / per_word).alias("symbol_ratio"),
            (counts["dup_lines"] / F.greatest(F.size(lines), F.lit(1))).alias("dup_line_ratio"),
            (F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))) / per_word).alias("stop_word_ratio"),
            (_removed(t, "[A-Z]+") / F.greatest(counts["chars"], F.lit(1))).alias("upper_ratio"),
            ((F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))) / per_word).alias("bang_ratio"),
        )

    def counted(t: Column, words: Column, lines: Column) -> Column:
        counts = F.struct(
            F.length(F.array_join(words, "")).alias("chars"),
            F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).alias("symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup_lines"),
        )
        return let(counts, lambda c: of_words(t, words, lines, c))

    def lined(t: Column, words: Column) -> Column:
        return let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda ls: counted(t, words, ls))

    return let(text, lambda t: let(F.filter(F.split(t, SPACE_CLASS + "+"), lambda w: w != ""), lambda words: lined(t, words)))


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True if every rule of the table holds."""
    ok = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            ok = ok & (m[rule.measure] >= rule.low)
        if rule.high is not None:
            ok = ok & (m[rule.measure] <= rule.high)
    return ok


def assess(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures, base_failed and kept; one projection, no shuffle."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = docs.drop(*names, "base_failed", "kept").withColumn("__m", measures(docs[text]))
    m = F.col("__m")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return out.select(*[c for c in out.columns if c != "__m"], *[m[n].alias(n) for n in names], failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go; the columns stay as they were."""
    m = F.col("__m")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return docs.withColumn("__m", measures(docs["text"])).where(~failed & verdict(m)).drop("__m")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: The same in DuckDB's SQL.
SQL_OP7 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), tri AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT doc_id, t, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         greatest(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')), 1) AS letters,
         length(t) - length(replace(t, '!', '')) AS n_bang
  FROM w LEFT JOIN cov USING (rid)
), f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, greatest(n_words, 1) AS per FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / per >= 1.5 AND word_chars / per <= 20.0 AND n_symbols / per <= 0.25
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_stop / per >= 0.02 AND n_upper / letters <= 0.5
       AND n_bang / per <= 0.5 AS kept
FROM f
"""
