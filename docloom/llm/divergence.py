"""Operator 12, source divergence audit: how far the vocabularies of a language's sources lie apart, exactly.

Every (lang, source) group gives each kept term of its language a smoothed whole number p. Two groups differ by the
sum over all kept terms of f(p, q) = floor((p - q)^2 / (p + q)). That sum isn't taken over all terms for each pair of groups.
Inclusion-exclusion over the supports (the terms that a group has) gives it from three parts:

- a term that only one of both has costs f(p(count), p(0) of the other), which depends on the count alone, so a group's
  histogram of counts prices all its terms against another group at once, as if the other had none of them;
- terms that both have were priced twice and wrongly: the postings of a term, joined with themselves, correct them;
- terms that neither has cost a constant each, f of the two p(0).

Terms are counted in tasks first (bounded dictionaries), so a frequent term or a hot source sends a row for each dictionary,
not for each occurrence. A term's posting list has a row for each source. Its pairs are summed by pair of
sources in the task that makes them.

Cases: a null text, lang or source is ''; a text without terms still makes its group occur; a language without kept
terms has pairs of value 0; a language of one source has no pairs; an empty table gives no rows; repeated rows count each; ties
of value rank by item in UTF-8; doc_id and other columns are never read, so their nulls, repeats and names don't matter; texts of any
length are counted whole. Counts of up to 9 * 10^13 are exact (beyond, the sum raises an error).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, slices, store, temporary_stores

#: Terms of a language that are kept occur in so many of its documents; ranks of the term part that are reported.
LEAST_DOCUMENTS, TOP_TERMS = 10, 10
#: Entries of a task's dictionary before it is sent; more of them only save rows.
ENTRIES = 1 << 17
#: Everything below U+0080 but letters parts terms, and A-Z become a-z; bytes of longer characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Rows of one lang are dealt to so many keys where other columns can't deal them.
SALT = 32


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term) -> n occurrences, docs that have it; and a row without a term for each group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def sent(kept: dict[tuple[bytes, bytes], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in kept.items():
            terms, packed = [None, *counts], [0, *counts.values()]
            size = len(terms)
            cols = [[lang] * size, [source] * size, terms]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.binary()).cast(pa.string()) for c in cols), pa.array([x >> 32 for x in packed], pa.int64()), pa.array([x & 0xFFFFFFFF for x in packed], pa.int64())], schema=schema
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[bytes, bytes], dict[bytes, int]] = defaultdict(dict)
        entries = 0
        for batch in slices(batches, "divergence"):
            for lang, source, text in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in range(3)), strict=True):
                counts = kept[lang or b"", source or b""]
                entries -= len(counts)
                get = counts.get
                for term, n in Counter(terms_of(text or b"")).items():
                    counts[term] = get(term, 0) + (n << 32 | 1)  # occurrences above, documents below
                entries += len(counts)
                if entries >= ENTRIES:
                    yield from sent(kept)
                    kept.clear()
                    entries = 0
        yield from sent(kept)

    made = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / total) in whole numbers: two steps keep the products within a long."""

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    scaled = (count + 2) * 100_000
    return div(scaled, total) * 10_000 + div(F.pmod(scaled, total) * 10_000, total) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_sizes(counts: DataFrame, postings: DataFrame) -> DataFrame:
    """Every group with kept (terms kept in its lang), amount and support (occurrences and number of those it has), p0."""
    of_lang = postings.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_amount"))
    of_group = postings.groupBy("lang", "source").agg(F.sum("n").alias("amount"), F.count(F.lit(1)).alias("support"))
    out = counts.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["kept", "lang_amount", "amount", "support"])
    return out.withColumn("p0", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("amount") + 2 * F.col("kept"))))


def pair_values(postings: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, lo, hi, value) for all pairs of sources of a lang. postings: lang, source, term, n, p, p0."""
    other = sizes.select("lang", F.col("source").alias("hi"), F.col("p0").alias("p0_hi"), F.col("support").alias("support_hi"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))

    def salted(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALT)).cast("int"))

    # Neither has the term, and the pair itself.
    pairs = salted(sizes.select("lang", F.col("source").alias("lo"), "p0", "kept", "support"), "lo").join(other, ["lang", "salt"]).where(F.col("lo") < F.col("hi"))
    neither = pairs.select("lang", "lo", "hi", F.coalesce((F.col("kept") - F.col("support") - F.col("support_hi")) * distance(F.col("p0"), F.col("p0_hi")), F.lit(0)).alias("value"))
    # One has it: the histogram of a group's counts against the p(0) of every other group.
    histogram = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    sided = salted(histogram, "source", "p").join(other, ["lang", "salt"]).where(F.col("source") != F.col("hi"))
    sided = sided.select("lang", F.least("source", "hi").alias("lo"), F.greatest("source", "hi").alias("hi"), (F.col("terms") * distance(F.col("p"), F.col("p0_hi"))).alias("value"))
    # Both have it: take the two prices back, and the constant, and put the right one in.
    a = postings.select("lang", "term", F.col("source").alias("lo"), F.col("p").alias("p1"), F.col("p0").alias("z1"))
    b = postings.select("lang", "term", F.col("source").alias("hi"), F.col("p").alias("p2"), F.col("p0").alias("z2"))
    p1, p2, z1, z2 = map(F.col, ("p1", "p2", "z1", "z2"))
    both = a.join(b, ["lang", "term"]).where(F.col("lo") < F.col("hi"))
    both = both.select("lang", "lo", "hi", (distance(p1, p2) - distance(p1, z2) - distance(z1, p2) + distance(z1, z2)).alias("value"))
    # Each part is summed on its own first, in the tasks that make it.
    parts = [x.groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value")) for x in (neither, sided, both)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """docs(lang, source, text) -> lang, source, part, item, value, rank."""
    with temporary_stores(docs.sparkSession):
        counts = store(term_counts(docs))
        kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_documents)
        postings = store(counts.join(kept.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "total"))
        sizes = store(group_sizes(counts, postings))
        total = F.col("amount") + 2 * F.col("kept")
        postings = store(
            postings.join(sizes, ["lang", "source"]).select("lang", "source", "term", "n", "p0", share(F.col("n"), total).alias("p"), share(F.col("total"), F.col("lang_amount") + 2 * F.col("kept")).alias("q"))
        )
        by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        pairs = pair_values(postings, sizes)
        both_ways = F.explode(F.array(F.struct(F.col("lo").alias("source"), F.col("hi").alias("item")), F.struct(F.col("hi").alias("source"), F.col("lo").alias("item")))).alias("x")
        pairs = pairs.select("lang", "value", both_ways).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(by_value))
        terms = postings.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
        terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)
        return materialize(pairs.unionByName(terms))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents", "lang", "source", "text"))


#: The same in DuckDB's SQL, over all terms for each pair.
SQL_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), w AS (SELECT rid, lang, source, unnest(ts) AS term FROM d
), k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10
), l AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
), s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 2)) // (l.nl + 2 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
