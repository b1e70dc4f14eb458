"""Operator 4, personal data: protected entities, and corpus statistics for the terms that give them away.

Patterns find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. Secrets (keys, tokens, passwords)
have no pattern but information: a run of SECRET_CHARS or more key characters with a digit in it is protected if the
corpus' own pairs of neighbouring characters make it improbable by SECRET_BITS bits in all and by MEAN_BITS a
character. Pairs with digits aren't counted, so secrets don't get probable by being many; an uncounted pair costs
MOST_BITS.

A term discloses a kind of entity as far as it raises its probability: with p(kind) the share of documents that
hold the kind and p(kind | term) the share among those with the term, PMI = log p(kind | term) / p(kind) is set
against the information -log p(kind) that the kind itself carries. The ratio is 1 if the term always comes with
the kind and 0 if the two are independent. All words outside entities are terms, and all documents count: a term
that reaches the threshold in SUPPORT contexts is a span wherever it stands, in documents without an entity as well:
GENERALISE or more are replaced by the name of the kind, REMOVE or more go. A context is the NEAR words before and
after the term's first place in a document with the kind. Contexts are counted by their collision entropy (the square
of the sum of their documents by the sum of squares), so that copies of one text, equal or edited, don't make a rule.

One scan counts pairs of characters (65,536 numbers at most). A second counts within each task, in how many documents
each term occurs and, over the documents with entities, in how many of each kind; what is shuffled is a row for each
task, term and kind. A third counts the contexts of the terms over the threshold. Disclosing terms go out in blocks of TERMS_PER_BLOCK, each against all documents; no text is
shuffled.

Cases: a null text is empty, an empty table gives an empty one; texts of any length are read whole; spans of different
kinds may overlap and all are kept (masking merges them, the first and longest names the mask); repeated rows get the
same spans; a null doc_id is a document like any other. The columns __spans and __terms of an input are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, store, temporary_stores

KINDS = ("email", "ip", "card", "phone")
PROTECTED = (*KINDS, "secret")
SECRET_CHARS, SECRET_BITS, MEAN_BITS, MOST_BITS = 16, 80.0, 5.0, 8.0
NEAR, SUPPORT, GENERALISE, REMOVE = 3, 5, 0.8, 0.95
FLUSH_TERMS, TERMS_PER_BLOCK = 300_000, 500_000

_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken from their start and whole: that is where the leftmost match begins and how far it goes. That no
# digit lies before is looked up after the first one, as patterns that begin with a set of characters skip all others fast.
_IP = re.compile(r"([0-9](?<![0-9][0-9])[0-9]*+)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?<![0-9][0-9])(?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_WORD_EDGE = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * 32 + b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+")


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address is found from its @: the run of local characters before it, not into the last match."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all base matches, by start, then kind as listed; code points, end exclusive."""
    out = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and (len(x) <= 3 or not x[:-3].strip("0")) for x in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


#: Bytes for the pairs: letters in lower case, digits as one, other ASCII characters as borders of words.
_PAIRED = np.array([ord(c.lower()) if (c := chr(b)).isascii() and c.isalpha() else 1 if c.isdigit() and b < 128 else b if b >= 128 else 0 for b in range(256)], np.uint8)
_KEY, _DIGIT, _LETTER = re.compile(rf"[A-Za-z0-9_+/=-]{{{SECRET_CHARS},}}"), re.compile("[0-9]"), re.compile("[A-Za-z]")


def pair_counts(texts: list[str]) -> np.ndarray:
    """How often each pair of neighbouring bytes occurs, a pair as one number; pairs with digits are left out. Every
    text stands between line feeds, so the counts of all texts are the sums of those of each."""
    line = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    line = _PAIRED[line].astype(np.int32)
    pairs = line[:-1] << 8 | line[1:]
    return np.bincount(pairs[(line[:-1] != 1) & (line[1:] != 1)], minlength=1 << 16)


def pair_bits(counts: np.ndarray) -> np.ndarray:
    """-log2 of the probability of a byte after another, MOST_BITS at most; half a pair more of each kind."""
    table = counts.reshape(256, 256)
    return np.minimum(-np.log2((table + 0.5) / (table.sum(1, keepdims=True) + 128)), MOST_BITS)


def character_bits(docs: DataFrame, text: str = "text") -> np.ndarray:
    """pair_bits() of all texts; a row for each pair of bytes reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in slices(batches):
            total += pair_counts([t or "" for t in batch.column(0).to_pylist()])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["pair", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for r in docs.select(text).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair] = r.n
    return pair_bits(counts)


def secrets(text: str, bits: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of the improbable runs of key characters."""
    if not _DIGIT.search(text):
        return []
    out = []
    for m in _KEY.finditer(text):
        if _DIGIT.search(m[0]) and _LETTER.search(m[0]):
            run = _PAIRED[np.frombuffer((" " + m[0]).encode(), np.uint8)]
            cost = float(bits[run[:-1], run[1:]].sum())
            if cost >= SECRET_BITS and cost >= MEAN_BITS * len(m[0]):
                out.append((*m.span(), "secret"))
    return out


def protected_spans(text: str, bits: np.ndarray) -> list[tuple[int, int, str]]:
    """Base spans and, outside them, secrets, by start."""
    base = base_spans(text)
    more = secrets(outside(text, base), bits)
    return sorted(base + more, key=lambda x: (x[0], PROTECTED.index(x[2]))) if more else base


def words(text: str) -> list[bytes]:
    """A text's terms in order: words between white space and ASCII punctuation, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_EDGE).split()


def outside(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a space for every character of an entity."""
    out, at = [], 0
    for s, e, _ in spans:
        if e > at:
            s = max(s, at)
            out += [text[at:s], " " * (e - s)]
            at = e
    return "".join([*out, text[at:]]) if spans else text


def term_spans(text: str, told: dict[bytes, list[tuple[str, float]]]) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of every place of the terms told, in a text without its entities."""
    if told.keys().isdisjoint(words(text)):
        return []
    return [(m.start(), m.end(), *x) for m in _WORD.finditer(text) for x in told.get(m[0].encode("utf-8", "surrogatepass").translate(_WORD_EDGE), ())]


_JOINT = pa.schema([("term", pa.string()), ("kind", pa.string()), ("docs", pa.int64())])
_CONTEXTS = pa.schema([("term", pa.string()), ("kind", pa.string()), ("context", pa.int64()), ("docs", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)


def _counted(counts: Counter, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Counts by tuples that start with the term's bytes, 10,000 rows at a time; the counter is emptied."""
    rows = iter(counts.items())
    while some := list(islice(rows, 10_000)):
        keys, n = zip(*some, strict=True)
        term, *others = zip(*keys, strict=True)
        columns = [[None if w is None else w.decode("utf-8", "surrogatepass") for w in term], *others, n]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)
    counts.clear()


def _joint(sent):
    """(text) -> (term, kind, docs), counted within the task. Rows with a null term count documents with the kind,
    those with a null kind all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        totals: Counter = Counter()
        anywhere: Counter[bytes] = Counter()
        joint: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            yield from _counted(joint, _JOINT)
            both = Counter({(w, None): n for w, n in anywhere.items()})
            anywhere.clear()
            yield from _counted(both, _JOINT)

        for batch in slices(batches):
            totals[None, None] += batch.num_rows
            for text in batch.column(0).to_pylist():
                spans = protected_spans(text or "", bits)
                listed = set(words(outside(text or "", spans)))
                anywhere.update(listed)
                for kind in {kind for _, _, kind in spans}:
                    totals[None, kind] += 1
                    joint.update((w, kind) for w in listed)
            if len(joint) + len(anywhere) > FLUSH_TERMS:
                yield from flush()
        yield from flush()
        yield from _counted(totals, _JOINT)

    return run


def _contexts(sent):
    """(text) -> (term, kind, context, docs) for the terms sent, over the documents with the kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, bits = sent.value
        found: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                spans = protected_spans(text or "", bits)
                kinds = {kind for _, _, kind in spans}
                listed = words(outside(text or "", spans)) if kinds else []
                for w in asked.keys() & set(listed):
                    k = listed.index(w)
                    around = b" ".join([*listed[max(0, k - NEAR) : k], b"", *listed[k + 1 : k + 1 + NEAR]])
                    context = xxhash.xxh3_64_intdigest(around) >> 1
                    found.update((w, kind, context) for kind, _ in asked[w] if kind in kinds)
            if len(found) > FLUSH_TERMS:
                yield from _counted(found, _CONTEXTS)
        yield from _counted(found, _CONTEXTS)

    return run


def disclosing_terms(docs: DataFrame, text: str = "text", support: int = SUPPORT, threshold: float = GENERALISE, bits: np.ndarray | None = None) -> DataFrame:
    """(term, kind, score) of the terms that reach the threshold in contexts enough."""
    sc = docs.sparkSession.sparkContext
    bits = character_bits(docs, text) if bits is None else bits
    counted = store(docs.select(text).mapInArrow(_joint(sc.broadcast(bits)), _ddl(_JOINT)))
    of_kind = [F.sum(F.when(F.col("kind") == k, F.col("docs"))).alias(k) for k in PROTECTED]
    summed = counted.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.when(F.col("kind").isNull(), F.col("docs"))).alias("n_term"), *of_kind)
    n = {r.kind: r.docs for r in counted.where("term IS NULL").groupBy("kind").agg(F.sum("docs").alias("docs")).collect()}  # PROTECTED and the total
    shares = {kind: n[kind] / n[None] for kind in PROTECTED if 0 < n.get(kind, 0) < n[None]}
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("joint"), F.lit(p).alias("p")) for k, p in shares.items()]), lambda x: x["joint"] >= support) if shares else None
    if each is None:
        return docs.sparkSession.createDataFrame([], "term string, kind string, score double")
    scored = summed.select("term", "n_term", F.explode(each).alias("of")).select("term", "n_term", "of.*")
    scored = store(scored.withColumn("score", F.log(F.col("joint") / F.col("n_term") / F.col("p")) / -F.log("p")).where(F.col("score") >= threshold).select("term", "kind", "score"))
    seen = None
    for block in _term_blocks(scored):
        part = docs.select(text).mapInArrow(_contexts(sc.broadcast((block, bits))), _ddl(_CONTEXTS))
        seen = part if seen is None else seen.unionByName(part)
    by_context = seen.groupBy("term", "kind", "context").agg(F.sum("docs").cast("double").alias("n"))
    enough = by_context.groupBy("term", "kind").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("contexts")).where(F.col("contexts") >= support)
    return store(scored.join(enough, ["term", "kind"]).select("term", "kind", "score"))


def _term_blocks(told: DataFrame) -> Iterator[dict[bytes, list[tuple[str, float]]]]:
    """The terms in blocks of bounded number, streamed to the driver one partition at a time; one block at least."""
    block: dict[bytes, list[tuple[str, float]]] = {}
    some = False
    for row in told.toLocalIterator():
        block.setdefault(row.term.encode("utf-8", "surrogatepass"), []).append((row.kind, row.score))
        if len(block) >= TERMS_PER_BLOCK:
            yield block
            block, some = {}, True
    if block or not some:
        yield block


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string())]))
_TERMS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
_MARKS_DDL = "__spans array<struct<s: int, e: int, kind: string>>, __terms array<struct<s: int, e: int, kind: string, score: double>>"


def _marked(sent, text: str):
    """Rows with __spans and __terms; the terms of one block are added to those of the blocks before it. sent holds
    the block and the pair bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, bits = sent.value
        for batch in slices(batches):
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            before = column["__terms"].to_pylist() if "__terms" in column else [None] * batch.num_rows
            spans, found = [], []
            for t, old in zip(column[text].to_pylist(), before, strict=True):
                base = protected_spans(t or "", bits)
                new = term_spans(outside(t or "", base), told)
                spans.append([dict(zip(("s", "e", "kind"), x, strict=True)) for x in base] or None)
                found.append([*(old or ()), *(dict(zip(("s", "e", "kind", "score"), x, strict=True)) for x in new)] or None)
            column["__spans"], column["__terms"] = pa.array(spans, _SPANS), pa.array(found, _TERMS)
            yield pa.RecordBatch.from_arrays(list(column.values()), names=list(column))

    return run


def with_spans(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with __spans, the entities, and __terms, the disclosing terms (null where there are none)."""
    docs = docs.drop("__spans", "__terms")
    ddl = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), _MARKS_DDL])
    bits = character_bits(docs, text)
    out = docs
    with temporary_stores(docs.sparkSession):
        for block in _term_blocks(disclosing_terms(docs, text, bits=bits, **options)):
            out = out.mapInArrow(_marked(docs.sparkSession.sparkContext.broadcast((block, bits)), text), ddl)
    return out


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc, hash, spans, terms): for documents with entities or disclosing terms, the spans of both
    (s, e, kind; score), as arrays. doc is doc_id, hash that of the text: together they find the rows again."""
    found = with_spans(docs.select(doc_id, text), text, **options).where("__spans IS NOT NULL OR __terms IS NOT NULL")
    return found.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), F.col("__spans").alias("spans"), F.col("__terms").alias("terms")).dropDuplicates(["doc", "hash"])


def mask(text: str, spans: list[tuple[int, int, str]], told: list[tuple[int, int, str, float]]) -> str:
    """The text with entities and generalised terms replaced by [KIND], terms over REMOVE taken out. Overlapping
    spans are one, named by the first."""
    marks = sorted([(s, e, f"[{k.upper()}]") for s, e, k in spans] + [(s, e, "" if score >= REMOVE else f"[{k.upper()}]") for s, e, k, score in told], key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for s, e, label in marks:
        if s >= end:
            out += [text[end:s], label]
        end = max(end, e)
    return "".join([*out, text[end:]])


def mask_text(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with the text masked; null texts and those without spans as they were. Columns stay."""
    columns = docs.columns
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts = [
                t if not spans and not told else mask(t or "", [(x["s"], x["e"], x["kind"]) for x in spans or ()], [(x["s"], x["e"], x["kind"], x["score"]) for x in told or ()])
                for t, spans, told in zip(column[text].to_pylist(), column["__spans"].to_pylist(), column["__terms"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else column[c] for c in columns], names=columns)

    return with_spans(docs, text, **options).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in columns))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base digest holds the kinds of the patterns; spans also hold secrets and terms. n_spans counts all."""
    docs = with_spans(read_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "__spans", "__terms")

    def listed(spans):
        order = lambda x: F.struct(x["s"].alias("s"), F.array_position(F.array(*[F.lit(k) for k in (*PROTECTED, "term")]), x["kind"]).alias("r"), x["e"].alias("e"), x["kind"].alias("k"))
        return F.array_join(F.transform(F.array_sort(F.transform(spans, order)), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    def is_kind(name):
        return lambda x: x["kind"] == name

    kind = "array<struct<s: int, e: int, kind: string>>"
    found = F.coalesce("__spans", F.array().cast(kind))
    base = F.filter(found, lambda x: x["kind"] != "secret")
    told = F.coalesce(F.array_distinct(F.transform("__terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("term").alias("kind")))), F.array().cast(kind))
    counted = [F.size(F.filter(found, is_kind(k))).cast("long").alias(f"n_{k}") for k in PROTECTED]
    rows = docs.select("doc_id", *counted, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.concat(found, told)).alias("spans"), F.size(told).cast("long").alias("n_term"))
    total = sum((F.col(f"n_{k}") for k in PROTECTED), F.col("n_term"))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_secret", "n_term", total.alias("n_spans"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data and what gives it away are masked; every document stays."""
    return mask_text(docs)
