"""Operator 5, toxicity by weak supervision.

Terms are whole words and beginnings of words (4 to 6 letters). On a sample of labelled training rows, at most
SAMPLE of them (equal texts once), terms that come with label 1 far more often than not make the lexicons. Voters look at a text:
lexicon voters hold a share of one kind's terms and vote toxic on a hit; pattern voters vote on how many
different terms and how many kinds hit; clean voters vote against on no hit of a kind. Otherwise they abstain.
A generative label model knows no labels but their prior: expectation maximisation estimates how often each
voter votes what under either class, and the votes' remaining correlations within the classes discount voters
that say the same. Its posteriors are the targets of a logistic regression over the terms, which scores texts.
Where its scores part the labels best is found on the sample in FOLDS parts, each scored by a model of the other
parts, and the bias moves so that this place is 0.5; a text without terms always stays below.

Training rows are those whose crc32(doc_id as text) mod 5 isn't 0; no other label is read. The sample is taken
by the hash of the id; its ids go out as a broadcast, so documents aren't shuffled. Every term that reaches PRECISION
and EVIDENCE is in the model; there are no more than the sample has terms, so SAMPLE bounds the model, too.

Cases: null and empty texts have no terms and get the score of the bias; texts of any length are read whole; without
labels of both classes, without labels or without documents the score is near the class that there is (0 where there
are none at all); ids with both labels count as toxic, of documents with one id one is a sample; terms are in
order of evidence, then name; repeated rows come out once per row; columns named score and predicted are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, store, temporary_stores

SAMPLE, FOLDS = 20_000, 5
PRECISION, EVIDENCE, SHARES = 0.85, 11.0, 4
KINDS = ("word", "4", "5", "6")
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def text_terms(text: str | None) -> set[str]:
    """Words and, marked with a star, their first four to six letters."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in (4, 5, 6)))


def kind_of(term: str) -> str:
    return str(len(term) - 1) if term.endswith("*") else "word"


def term_counts(sample: DataFrame) -> DataFrame:
    """sample(text, y, fold) -> (term, fold, toxic, clean): documents with the term, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text, y, fold in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                seen.update((t, fold, y) for t in text_terms(text))
        terms, folds, labels = zip(*seen, strict=True) if seen else ((), (), ())
        n, y = np.fromiter(seen.values(), np.int64, len(seen)), np.array(labels, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(folds, pa.int64()), pa.array(np.where(y > 0, n, 0)), pa.array(np.where(y > 0, 0, n))], names=["term", "fold", "toxic", "clean"])

    rows = sample.select("text", "y", F.col("fold").cast("long")).mapInArrow(run, "term string, fold long, toxic long, clean long")
    return rows.groupBy("term", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_terms(counts: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """Terms whose documents are toxic by PRECISION or more, and so much more often than the base rate that the
    likelihood ratio has EVIDENCE nats; the greatest evidence first."""
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    base = n_toxic / (n_toxic + n_clean)
    precision = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1.0)
    evidence = F.col("toxic") * F.log(precision / base) + F.col("clean") * F.log((1 - precision) / (1 - base))
    rows = counts.where((precision >= PRECISION) & (evidence >= EVIDENCE)).orderBy(evidence.desc(), "term")
    return [r.term for r in rows.select("term").collect()]


def votes(hits: list[list[int]], terms: list[str]) -> np.ndarray:
    """One row of votes (1, -1, 0 for none) for each text's list of hit terms."""
    place = {k: i for i, k in enumerate(KINDS)}
    kinds = np.array([place[kind_of(t)] for t in terms], int)
    order = np.zeros(len(kinds), int)
    for k in range(len(KINDS)):
        order[kinds == k] = np.arange((kinds == k).sum()) % SHARES
    out = np.zeros((len(hits), len(KINDS) * (SHARES + 1) + 3), np.int8)
    for row, found in zip(out, hits, strict=True):
        some = np.array(found, int)
        row[kinds[some] * SHARES + order[some]] = 1
        per_kind = np.bincount(kinds[some], minlength=len(KINDS))
        row[len(KINDS) * SHARES : len(KINDS) * (SHARES + 1)] = np.where(per_kind == 0, -1, 0)
        row[-3] = 1 if len(found) >= 3 else 0
        row[-2] = 1 if (per_kind > 0).sum() >= 2 else 0
        row[-1] = -1 if not found else 0
    return out


def label_model(v: np.ndarray, prior: float, rounds: int = 50) -> np.ndarray:
    """Posterior of class 1 for each row of votes. Per voter and class, the probabilities of its three votes are
    estimated by expectation maximisation from the majority; correlations left within the classes make a voter
    count for less, by 1 + the sum of those with the others."""
    index = v.astype(int) + 1
    onehot = np.eye(3)[index]  # rows, voters, votes
    score = v.sum(1)
    posterior = np.where(score > 0, 0.9, np.where(score < 0, 0.1 * prior, prior))
    share = np.ones(v.shape[1])
    base = np.log(prior) - np.log1p(-prior)
    for step in range(rounds):
        p1 = (np.einsum("r,rvk->vk", posterior, onehot) + 1) / (posterior.sum() + 3)
        p0 = (np.einsum("r,rvk->vk", 1 - posterior, onehot) + 1) / ((1 - posterior).sum() + 3)
        each = (np.log(p1) - np.log(p0))[np.arange(v.shape[1]), index]
        if step % 10 == 0:
            expected = posterior[:, None] * (p1[:, 2] - p1[:, 0]) + (1 - posterior)[:, None] * (p0[:, 2] - p0[:, 0])
            rest = v - expected
            sd = rest.std(0)
            used = sd > 1e-9
            correlation = np.zeros((v.shape[1],) * 2)
            if used.sum() > 1:
                correlation[np.ix_(used, used)] = np.corrcoef(rest[:, used].T)
            np.fill_diagonal(correlation, 0)
            share = 1 / (1 + np.maximum(correlation, 0).sum(1))
        posterior = 1 / (1 + np.exp(-np.clip(base + (each * share).sum(1), -30, 30)))
    return posterior


def fit_linear(hits: list[list[int]], target: np.ndarray, n_terms: int, penalty: float = 1.0, steps: int = 300) -> np.ndarray:
    """Logistic regression of target (probabilities) on the hits; the last weight is the bias. Gradient steps with
    a scale of their own for each weight."""
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    cols = np.fromiter((c for h in hits for c in h), int, len(rows))
    w = np.zeros(n_terms + 1)
    w[-1] = np.log(np.clip(target.mean(), 1e-6, 1 - 1e-6) / np.clip(1 - target.mean(), 1e-6, 1))
    seen = np.full(n_terms + 1, 1e-8)
    for _ in range(steps):
        z = w[-1] + np.bincount(rows, w[cols], len(hits))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(cols, error[rows], n_terms), error.sum())
        g[:-1] += penalty * w[:-1]
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[dict[str, float], float]:
    """(weight by term, bias). labels has doc_id and toxic; ids with both labels count as toxic."""
    with temporary_stores(docs.sparkSession):
        return _fit(docs, labels, doc_id, text)


def _fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> tuple[dict[str, float], float]:
    known = labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max("toxic").alias("y"))
    known = known.where(~held_out(F.col(doc_id))).orderBy(F.xxhash64(doc_id), doc_id).limit(SAMPLE)
    # SAMPLE rows of two numbers at most; of documents with one id the one with the least hash of its text is taken.
    rows = docs.join(F.broadcast(known), doc_id).select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("text"), "y")
    rows = rows.groupBy(doc_id, "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("t.text", "y")
    sample = store(rows.groupBy("text").agg(F.max("y").alias("y")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS))))
    parts = {(r.fold, r.y): r.n for r in sample.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = [sum(n for (_, y), n in parts.items() if y == label) for label in (1, 0)]
    if not all(whole):
        return {}, 30.0 if whole[0] else -30.0
    counts = store(term_counts(sample))
    terms = choose_terms(counts, *whole)
    if not terms:
        return {}, float(np.log(whole[0] / whole[1]))
    without = {f: [n - parts.get((f, label), 0) for n, label in zip(whole, (1, 0), strict=True)] for f in range(FOLDS)}
    of_fold = {f: choose_terms(counts.where(F.col("fold") != f), *n) if all(n) else [] for f, n in without.items()}
    known = set(terms).union(*of_fold.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(text_terms(x) & known) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1), batch.column(2)], names=["found", "y", "fold"])

    # SAMPLE rows at most, in an order that doesn't depend on tasks.
    rows = sorted((r.found, r.y, r.fold) for r in sample.select("text", F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold")).mapInArrow(run, "found array<string>, y int, fold int").collect())
    weight, bias = train([r[0] for r in rows], terms, whole[0] / sum(whole))
    apart = [train([r[0] for r in rows if r[2] != f], of_fold[f], n[0] / sum(n)) if all(n) else None for f, n in without.items()]
    judged = [(start + sum(of_term.get(t, 0.0) for t in found), y) for found, y, f in rows if apart[f] for of_term, start in [apart[f]]]
    lowest = max([bias, *(m[1] for m in apart if m)])
    return weight, bias - threshold(np.array([z for z, _ in judged]), np.array([y for _, y in judged], int), lowest)


def train(found: list[list[str]], terms: list[str], prior: float) -> tuple[dict[str, float], float]:
    """(weight by term, bias) from the terms found in each text."""
    if not terms:
        return {}, float(np.log(prior / (1 - prior)))
    number = {t: i for i, t in enumerate(terms)}
    hits = sorted(sorted(number[t] for t in x if t in number) for x in found)
    w = fit_linear(hits, label_model(votes(hits, terms), prior), len(terms))
    return {t: float(w[i]) for t, i in number.items()}, float(w[-1])


def threshold(z: np.ndarray, y: np.ndarray, lowest: float) -> float:
    """The place between two scores, or 0, above `lowest` (0 and more: none) where what lies above agrees best with label 1,
    by the harmonic mean of precision and recall; of equal places the one nearest to 0, of those the greater."""
    values = np.unique(z)
    cuts = np.append((values[1:] + values[:-1]) / 2, 0.0)
    cuts = cuts[cuts > lowest]
    if not len(cuts):
        return 0.0
    ordered = np.sort(z)
    positive = np.sort(z[y == 1])
    above, right = len(z) - np.searchsorted(ordered, cuts), len(positive) - np.searchsorted(positive, cuts)
    value = 2 * right / np.maximum(above + len(positive), 1)
    best = cuts[value >= value.max() - 1e-12]
    return float(min(best, key=lambda c: (abs(c), -c)))


def score(docs: DataFrame, weight: dict[str, float], bias: float, text: str = "text") -> DataFrame:
    """docs without text but with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast((weight, bias))
    kept = [c for c in docs.columns if c not in (text, "score", "predicted")]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_term, start = sent.value
        # A word and its beginnings, as terms of the model. Words are remembered up to a bound.
        of_word: dict[str, tuple[str, ...]] = {}
        nothing: tuple[str, ...] = ()
        for batch in slices(batches):
            scores = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                found: set[str] = set()
                for word in set(_WORD.findall((t or "").lower())):
                    terms = of_word.get(word)
                    if terms is None:
                        terms = tuple(x for x in (word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)) if x in of_term) or nothing
                        if len(of_word) > 500_000:
                            of_word.clear()
                        of_word[word] = terms
                    if terms:
                        found.update(terms)
                z = start + sum(of_term[x] for x in sorted(found))
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[*kept, "score", "predicted"]
            )

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "score double, predicted int"]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    weight, bias = fit(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, weight, bias).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
