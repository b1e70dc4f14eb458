"""Batch retrieval: TF-IDF weights, dense scores, fusion, boost, gate and tiered search.

The corpus is tokenised once, in chunks of neighbouring segments: a chunk has a dictionary of its terms, with the number
of its segments that have each, and its segments as places in that dictionary. The dictionaries alone meet to sum document
frequencies; a chunk gets back those of its own terms and makes norms and weights from them. So a term costs a row for each
chunk, not for each segment, and a chunk is of bounded size. A batch of questions shares one scan of the segments' weights: questions go out in blocks
of bounded size, each task scores its segments against them and keeps what can be among the k best of a question, so
nothing that grows with the product of both sides is shuffled. Scores are rounded before they rank, so that ties don't depend
on the order of addition.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.sources.files import kept, narrowed

TOKEN = r"[\p{L}\p{N}_]{2,}"
DIGITS = 6


def tokens(text: Column, ngram_max: int = 1) -> Column:
    """Runs of two or more word characters in lower case, and with ngram_max 2 also pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    if ngram_max == 1:
        return words
    rest = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    two = F.filter(F.zip_with(words, rest, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    return F.concat(words, two)


def term_counts(df: DataFrame, key: str, text: str = "text", ngram_max: int = 1, only: DataFrame | None = None) -> DataFrame:
    """(key, term, tf); with only(term), of these terms alone, the others gone before they are counted."""
    rows = df.select(key, F.explode(tokens(F.col(text), ngram_max)).alias("term"))
    rows = rows if only is None else rows.join(only, "term", "left_semi")
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_segments: DataFrame, min_df: int = 1) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1; n_segments is one row (n)."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return df.select("term", "df", (F.log((n_segments.scalar() + 1) / (F.col("df") + 1)) + 1).alias("idf"))


_WORD = re.compile(r"\w{2,}")


def _terms(text: str, ngram_max: int) -> Counter[str]:
    """tokens() of one text, counted."""
    words = _WORD.findall(text.lower())
    return Counter(words if ngram_max == 1 else [*words, *map(" ".join, pairwise(words))])


def _counted(words: pa.Array, sizes: np.ndarray, ngram_max: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of neighbouring texts, sizes[i] of the i-th one -> (terms, row, place, tf): the distinct terms, and by text and
    place of the term how often it is there; tokens() of each text, counted."""
    known = words.dictionary_encode()
    terms, place = known.dictionary, known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    if ngram_max > 1:
        first = np.flatnonzero(row[1:] == row[:-1])
        pairs, number = np.unique(place[first] * len(terms) + place[first + 1], return_inverse=True)
        two = pc.binary_join_element_wise(terms.take(pa.array(pairs // max(1, len(terms)))), terms.take(pa.array(pairs % max(1, len(terms)))), " ")
        place, row = np.concatenate([place, number + len(terms)]), np.concatenate([row, row[first]])
        terms = pa.concat_arrays([terms, two])
    key, tf = np.unique(row * max(1, len(terms)) + place, return_counts=True)
    return terms, key // max(1, len(terms)), key % max(1, len(terms)), tf.astype(np.int32)


#: A chunk takes so many words or terms, and the rest of the text that reaches them; so many texts are taken apart at a time.
CHUNK, SOME_TEXTS = 1 << 19, 64


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Rows (key, text) -> (keys, words, words of each text) of neighbouring rows, up to most words and no more rows than that."""
    keys: list[pa.Array] = []
    words: list[pa.Array] = []
    sizes: list[int] = []
    n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, SOME_TEXTS):
            part = batch.slice(at, SOME_TEXTS)
            found = [_WORD.findall((t or "").lower()) for t in part.column(1).to_pylist()]
            keys.append(part.column(0))
            words.append(pa.array([w for ws in found for w in ws], pa.string()))
            sizes += map(len, found)
            n += len(words[-1])
            if max(n, len(sizes)) >= most:
                yield pa.concat_arrays(keys), pa.concat_arrays(words), np.array(sizes, np.int64)
                keys, words, sizes, n = [], [], [], 0
    if sizes:
        yield pa.concat_arrays(keys), pa.concat_arrays(words), np.array(sizes, np.int64)


def _listed(row: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """values, in order of the rows that they belong to, as a list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), values)


def segment_terms(segments: DataFrame, ngram_max: int = 1, key: str = "seg_id") -> DataFrame:
    """(uid, key, terms, tfs): a row for each segment, its terms and how often it has each; no shuffle. uid numbers the
    rows; it stays once the table is stored. Counting is a small helper for batches of texts, as sorted arrays and lambda
    functions take several times as long."""
    names = ["uid", key, "terms", "tfs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for keys, words, sizes in _chunks(batches, CHUNK // 4):
            terms, row, place, tf = _counted(words, sizes, ngram_max)
            columns = [pa.array(np.arange(uid, uid + len(keys)), pa.int64()), keys, _listed(row, len(keys), terms.take(pa.array(place))), _listed(row, len(keys), pa.array(tf))]
            made = pa.RecordBatch.from_arrays(columns, names=names)
            uid += len(keys)
            yield from (made.slice(at, SLICE_ROWS) for at in range(0, len(keys), SLICE_ROWS))

    return segments.select(key, "text").mapInArrow(run, f"uid long, {key} {dict(segments.dtypes)[key]}, terms array<string>, tfs array<int>")


def _dealt(terms: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of each term, by a hash of its bytes. Terms are never empty."""
    out = [np.empty(0, np.int64)]
    for at in range(0, len(terms), 1 << 16):
        part = pa.concat_arrays([terms.slice(at, 1 << 16)])
        offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
        starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
        power = np.cumprod(np.full(sizes.max(), 0x9E3779B97F4A7C15, np.uint64))
        h = np.add.reduceat(data * power[np.arange(len(data)) - np.repeat(starts, sizes)], starts)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append((h >> np.uint64(33)).astype(np.int64) % buckets)
    return np.concatenate(out)


def _coded_rows(chunk: int, keys: pa.Array, terms: pa.Array, row: np.ndarray, place: np.ndarray, tf: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk as rows of coded(). row and place are in order."""

    def rows(n: int, **given: pa.Array) -> Iterator[pa.RecordBatch]:
        kinds = {"uid": pa.int64(), "seg_id": keys.type, "bucket": pa.int32(), "places": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32()), "terms": pa.list_(pa.string())}
        made = pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(n, chunk))} | {name: given.get(name, pa.nulls(n, kind)) for name, kind in kinds.items()})
        return (made.slice(at, SLICE_ROWS) for at in range(0, n, SLICE_ROWS))

    n = len(keys)
    gaps = np.where(np.diff(row, prepend=-1) > 0, place, np.diff(place, prepend=0)).astype(np.int32)
    yield from rows(n, uid=pa.array(np.arange(chunk << 21, (chunk << 21) + n), pa.int64()), seg_id=keys, places=_listed(row, n, pa.array(gaps)), tfs=_listed(row, n, pa.array(tf)))
    if len(terms):
        bucket = _dealt(terms, buckets)
        order = np.argsort(bucket, kind="stable")
        own, at = np.unique(bucket[order], return_inverse=True)
        held = np.bincount(place, minlength=len(terms)).astype(np.int32)[order]
        yield from rows(len(own), bucket=pa.array(own.astype(np.int32)), places=_listed(at, len(own), pa.array(order.astype(np.int32))), tfs=_listed(at, len(own), pa.array(held)), terms=_listed(at, len(own), terms.take(pa.array(order))))


def _coded_schema(seg_id: str) -> str:
    return f"chunk long, uid long, seg_id {seg_id}, bucket int, places array<int>, tfs array<int>, terms array<string>"


def buckets_for(segments: DataFrame) -> int:
    """Into how many buckets the terms of chunks are dealt: a bucket is to hold a small share of a partition's terms."""
    return 64 * max(1, segments.rdd.getNumPartitions())


def coded(segments: DataFrame, ngram_max: int, buckets: int) -> DataFrame:
    """segments(seg_id, text) in chunks, no shuffle. A row for each segment: (chunk, uid, seg_id, places, tfs), the places of its
    terms in the chunk's dictionary, each as what it is beyond the place before; and the dictionary, a row for each bucket: (chunk, bucket, places, tfs, terms), tfs being in
    how many of the chunk's segments a term is. To be stored before it is read twice, as chunks are numbered by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 22
        for keys, words, sizes in _chunks(batches, CHUNK):
            yield from _coded_rows(chunk, keys, *_counted(words, sizes, ngram_max), buckets)
            chunk += 1

    return segments.select("seg_id", "text").mapInArrow(run, _coded_schema(dict(segments.dtypes)["seg_id"]))


def coded_terms(forward: DataFrame, buckets: int) -> DataFrame:
    """coded() of segments whose terms are counted already: forward(seg_id, terms, tfs)."""

    def close(chunk: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.concat_arrays([p.column(1).flatten() for p in parts]).dictionary_encode()
        sizes = np.concatenate([pc.list_value_length(p.column(1)).to_numpy(zero_copy_only=False) for p in parts])
        tf = np.concatenate([p.column(2).flatten().to_numpy(zero_copy_only=False) for p in parts])
        row, place = np.repeat(np.arange(len(sizes)), sizes), known.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(row * max(1, len(known.dictionary)) + place)
        yield from _coded_rows(chunk, pa.concat_arrays([p.column(0) for p in parts]), known.dictionary, row, place[order], tf[order], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, n, rows = TaskContext.get().partitionId() << 22, [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SOME_TEXTS):
                parts.append(batch.slice(at, SOME_TEXTS))
                n, rows = n + len(parts[-1].column(1).flatten()), rows + parts[-1].num_rows
                if max(n, rows) >= CHUNK:
                    yield from close(chunk, parts)
                    chunk, parts, n, rows = chunk + 1, [], 0, 0
        if parts:
            yield from close(chunk, parts)

    return forward.select("seg_id", "terms", "tfs").mapInArrow(run, _coded_schema(dict(forward.dtypes)["seg_id"]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, as a table for each of its values."""
    key = None
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        first = batch.column(0).to_numpy(zero_copy_only=False)
        for start, end in pairwise([0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]):
            if start < end:
                if parts and first[start] != key:
                    yield pa.Table.from_batches(parts).combine_chunks()
                    parts = []
                key = first[start]
                parts.append(batch.slice(start, end - start))
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks) if table.num_rows else pa.array([], table.schema.field(name).type)


def frequencies(chunks: DataFrame, wanted: DataFrame | None = None, min_df: int = 1) -> DataFrame:
    """coded() -> what is known of its terms, by bucket. Rows (chunk, places, dfs, names): the document frequencies of a chunk's
    terms, names being null where a term isn't among those of wanted (coded() too; without it all are). Terms of fewer than
    min_df segments, and of one alone that isn't wanted, are left out. Rows without a chunk: the wanted terms and their frequencies."""
    rows = chunks.where("bucket IS NOT NULL").select("bucket", "chunk", "places", "tfs", "terms")
    every = wanted is None
    if not every:
        rows = rows.unionByName(wanted.where("bucket IS NOT NULL").select("bucket", F.lit(None).cast("long").alias("chunk"), "places", "tfs", "terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            terms = _column(table, "terms")
            known = terms.flatten().dictionary_encode()
            code = known.indices.to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
            chunk = _column(table, "chunk")
            asking = pc.is_null(chunk).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            n = np.where(asking[row], 0, _column(table, "tfs").flatten().to_numpy(zero_copy_only=False))
            df = np.bincount(code, n, len(known.dictionary)).astype(np.int32)
            named = np.full(len(df), every)
            named[code[asking[row]]] = True
            back = np.flatnonzero(~asking[row] & (df[code] >= min_df) & (named[code] | (df[code] > 1)))
            places, given = _column(table, "places").flatten().take(pa.array(back)), code[back]
            names = known.dictionary.take(pa.array(given, mask=~named[given]))
            out = [chunk, *(_listed(row[back], len(sizes), x) for x in (places, pa.array(df[given]), names))]
            made = pa.RecordBatch.from_arrays(out, names=["chunk", "places", "dfs", "names"])
            yield made.filter(pc.and_(pc.is_valid(chunk), pc.greater(pc.list_value_length(out[1]), 0)))
            own = np.flatnonzero(named & (df >= max(1, min_df)))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([df[own]], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), known.dictionary.take(pa.array(own)))], names=["chunk", "places", "dfs", "names"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk long, places array<int>, dfs array<int>, names array<string>")


def known_terms(found: DataFrame) -> DataFrame:
    """frequencies() -> (term, df) of the wanted terms."""
    return found.where("chunk IS NULL").select(F.explode(F.arrays_zip("names", "dfs")).alias("x")).select(F.col("x.names").alias("term"), F.col("x.dfs").cast("long").alias("df"))


def with_idf(df: DataFrame, n: int, min_df: int = 1) -> DataFrame:
    """(term, df) of n segments -> (term, df, idf)."""
    return df.where(F.col("df") >= min_df).select("term", "df", (F.log(F.lit(float(n + 1)) / (F.col("df") + 1)) + 1).alias("idf"))


#: At most so many terms are in more than one HEAVY-th of all (segment, term) rows each, as shares add up to one.
HEAVY = 50_000


def spread(df: DataFrame, near: str | None = None) -> DataFrame:
    """Few large partitions (a table of one file, say) dealt to all cores, rows with near values of a column together if one
    is named; more partitions than cores stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartitionByRange(cores, near).sortWithinPartitions(near) if near else df.repartition(cores)


def weighed(rows: DataFrame, vocab: DataFrame, keys: tuple[str, ...], more: tuple[str, ...] = (), total: int | None = None) -> DataFrame:
    """rows(keys..., term, tf) and vocab(term, df, idf, more...) -> (keys..., term, raw, more...), raw being tf times idf. A term that is in
    many rows never is the key of a shuffle: it is looked up in the broadcast part. total: the sum of df, if known."""
    total = (vocab.agg(F.sum("df")).first()[0] or 0) if total is None else total
    needed = vocab.select("term", "idf", *more)
    many = F.col("df") > total // HEAVY
    looked_up = rows.join(F.broadcast(vocab.where(many).select(F.col("term").alias("__term"), "idf", *more)), F.col("term") == F.col("__term"), "left").drop("__term")
    frequent = looked_up.where("idf IS NOT NULL")
    rest = looked_up.where("idf IS NULL").select(*rows.columns).join(vocab.where(~many).select(*needed.columns), "term")
    out = [*keys, "term", (F.col("tf") * F.col("idf")).alias("raw"), *more]
    return frequent.select(*out).unionByName(rest.select(*out))


def weigh(counts: DataFrame, vocab: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """(key, term, w): tf times idf over the row's L2 norm."""
    raw = weighed(counts, vocab, (key,), total=total)
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("w"))


def unfolded(forward: DataFrame) -> DataFrame:
    """segment_terms() as rows (uid, key, term, tf)."""
    own = [c for c in forward.columns if c not in ("terms", "tfs")]
    return forward.select(*own, F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(*own, F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))


def question_terms(questions: DataFrame, ngram_max: int = 1) -> DataFrame:
    """(query_id, term, tf), counted as in segments."""
    rows = unfolded(segment_terms(questions, ngram_max, "query_id"))
    return rows.groupBy("query_id", "term").agg(F.sum("tf").alias("tf"))


@dataclass
class _Chunk:
    """A chunk's segments and what came back of its terms: places, document frequencies and, of those that are wanted, names."""

    uids: np.ndarray
    seg_ids: pa.Array
    row: np.ndarray
    place: np.ndarray
    tf: np.ndarray
    entry: np.ndarray
    df: np.ndarray
    names: pa.Array

    @classmethod
    def of(cls, table: pa.Table) -> _Chunk:
        """Rows of _by_chunk(), the terms' first."""
        n = table.column("uid").null_count
        flat = lambda rows, name: _column(rows, name).flatten()
        head, own = table.slice(0, n), table.slice(n)
        sizes = pc.list_value_length(_column(own, "places")).to_numpy(zero_copy_only=False)
        gaps, *numbers = [flat(*x).to_numpy(zero_copy_only=False) for x in ((own, "places"), (own, "tfs"), (head, "places"), (head, "tfs"))]
        row, total = np.repeat(np.arange(len(sizes)), sizes), np.append(0, np.cumsum(gaps, dtype=np.int64))
        place = total[1:] - total[np.cumsum(sizes) - sizes][row]
        return cls(_column(own, "uid").to_numpy(zero_copy_only=False), _column(own, "seg_id"), row, place, *numbers, flat(head, "terms"))

    def weights(self, n: int, df: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, entry, tf, weight) of the wanted terms: tf times idf over the norm of all terms; and the norms. df: the frequency of
        the terms that didn't come back; None: they don't count."""
        size = 1 + max(self.place.max(initial=0), self.entry.max(initial=0))
        idf = np.full(size, 0.0 if df is None else np.log((n + 1) / (df + 1)) + 1)
        idf[self.entry] = _idf(n, self.df)
        raw = self.tf * idf[self.place]
        norm = np.sqrt(np.bincount(self.row, raw * raw, len(self.uids)))
        number = np.full(size, -1)
        wanted = np.flatnonzero(pc.is_valid(self.names).to_numpy(zero_copy_only=False))
        number[self.entry[wanted]] = wanted
        at = np.flatnonzero(number[self.place] >= 0)
        return self.row[at], number[self.place[at]], self.tf[at], raw[at] / norm[self.row[at]], norm


def _by_chunk(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """coded() and frequencies() side by side, each chunk in one task, its terms first."""
    own = chunks.where("uid IS NOT NULL").select("chunk", "uid", "seg_id", "places", "tfs", F.lit(None).cast("array<string>").alias("terms"))
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in chunks.dtypes if name in ("uid", "seg_id")]
    rows = own.unionByName(found.where("chunk IS NOT NULL").select("chunk", *empty, "places", F.col("dfs").alias("tfs"), F.col("names").alias("terms")))
    return rows.repartition("chunk").sortWithinPartitions("chunk", "uid")


def segment_weights(chunks: DataFrame, found: DataFrame, n: int, min_df: int = 1) -> DataFrame:
    """(uid, seg_id, terms, weights) of n segments: tf times idf over the norm of all terms, given for the wanted ones. chunks is
    coded(), stored; found its frequencies()."""
    df = 1 if min_df <= 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in map(_Chunk.of, _runs(batches)):
            row, entry, _, weight, _ = chunk.weights(n, df)
            rows = len(chunk.uids)
            made = pa.RecordBatch.from_arrays([pa.array(chunk.uids, pa.int64()), chunk.seg_ids, _listed(row, rows, chunk.names.take(pa.array(entry))), _listed(row, rows, pa.array(weight))], names=["uid", "seg_id", "terms", "weights"])
            made = made.filter(pc.greater(pc.list_value_length(made.column(2)), 0))
            yield from (made.slice(at, SLICE_ROWS) for at in range(0, made.num_rows, SLICE_ROWS))

    return _by_chunk(chunks, found).mapInArrow(run, f"uid long, seg_id {dict(chunks.dtypes)['seg_id']}, terms array<string>, weights array<double>")


#: Rows of postings().
POSTINGS = "term string, block long, df int, most double, seg_ids array<smallint>, tfs array<int>, segs array<long>, norms array<double>"


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log((n + 1) / (df + 1)) + 1


def _raised(x: np.ndarray) -> np.ndarray:
    """x > 0 rounded up to eight binary digits, so that few different numbers are stored."""
    part, power = np.frexp(x)
    return np.ldexp(np.ceil(part * 256) / 256, power)


def postings(chunks: DataFrame, found: DataFrame, n: int, block_rows: int, min_df: int = 1) -> DataFrame:
    """What these weights are made of, by term. A row for each term and block of so many neighbouring segments: (term, block, df, most,
    seg_ids, tfs), the segments that have it by their place in the block, how often they do, and a bound of the greatest weight in
    it, hardly above it. And a row for each block, without a term: (block, segs, norms), its segments by their place."""
    df = 1 if min_df <= 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in map(_Chunk.of, _runs(batches)):
            row, entry, tf, weight, norm = chunk.weights(n, df)
            # Terms in their order lie beside similar ones, which takes less space.
            ordered = pc.sort_indices(chunk.names).to_numpy()
            entry = np.argsort(ordered)[entry]
            cuts = np.searchsorted(row, np.arange(0, len(chunk.uids) + block_rows, block_rows))
            for number, (start, end) in enumerate(pairwise(cuts.tolist())):
                if start < end:
                    order = start + np.argsort(entry[start:end], kind="stable")
                    terms, first = np.unique(entry[order], return_index=True)
                    ends = pa.array(np.append(first, len(order)), pa.int32())
                    block, at = (int(chunk.uids[0]) + number * block_rows) // block_rows, number * block_rows
                    segs = chunk.seg_ids.slice(at, block_rows).cast(pa.int64())
                    made = {
                        "term": chunk.names.take(pa.array(ordered[terms])), "block": pa.array(np.full(len(terms), block), pa.int64()), "df": pa.array(chunk.df[ordered[terms]], pa.int32()),
                        "most": pa.array(_raised(np.maximum.reduceat(weight[order], first))), "seg_ids": pa.ListArray.from_arrays(ends, pa.array((row[order] - at).astype(np.int16))), "tfs": pa.ListArray.from_arrays(ends, pa.array(tf[order], pa.int32())),
                        "segs": pa.nulls(len(terms), pa.list_(pa.int64())), "norms": pa.nulls(len(terms), pa.list_(pa.float64())),
                    }
                    whole = {"block": [block], "seg_ids": [[]], "tfs": [[]], "segs": [segs.to_pylist()], "norms": [norm[at : at + len(segs)]]}
                    yield pa.RecordBatch.from_pydict(made)
                    yield pa.RecordBatch.from_pydict({name: pa.array(whole.get(name, [None]), column.type) for name, column in made.items()})

    return _by_chunk(chunks, found).mapInArrow(run, POSTINGS)


def top_k(scored: DataFrame, k: int, query: str = "query_id", seg: str = "seg_id", score: str = "score") -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), seg)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: A block holds so many questions and so many of their terms at most; so many blocks share a scan, so many rows are scored at
#: a time.
BLOCK_QUESTIONS, BLOCK_TERMS, SHARED_BLOCKS, SLICE_ROWS = 500, 50_000, 16, 1024
_HITS = "query_id long, seg_id long, score double"


def _hits(ids: np.ndarray, segs: np.ndarray, scores: np.ndarray, k: int, positive: bool) -> pa.RecordBatch:
    """Of scores (segments by questions) the entries that reach the k-th best of their question, ties included."""
    rounded = np.round(scores, DIGITS) + 0.0
    k = min(k, len(segs))
    least = np.partition(rounded, len(segs) - k, axis=0)[len(segs) - k]
    seg, query = np.nonzero((rounded >= least) & ((rounded > 0) | (not positive)))
    return pa.RecordBatch.from_arrays([pa.array(ids[query], pa.int64()), pa.array(segs[seg], pa.int64()), pa.array(rounded[seg, query])], names=["query_id", "seg_id", "score"])


def _question_blocks(asked: DataFrame) -> Iterator[list[tuple[int, list[str], list[float]]]]:
    """(query_id, term, w) as blocks of whole questions, streamed to the driver."""
    block: list[tuple[int, list[str], list[float]]] = []
    size = 0
    for row in asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("ws")).toLocalIterator():
        block.append((row.query_id, [x.term for x in row.ws], [x.w for x in row.ws]))
        size += len(row.ws)
        if len(block) == BLOCK_QUESTIONS or size >= BLOCK_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


class _Block:
    """A block of questions, by term."""

    def __init__(self, block: list[tuple[int, list[str], list[float]]]):
        self.ids = np.array([q for q, _, _ in block], np.int64)
        self.known = pa.array(sorted({t for _, ts, _ in block for t in ts}), pa.string())
        number = {t: i for i, t in enumerate(self.known.to_pylist())}
        by_term: list[list[tuple[int, float]]] = [[] for _ in number]
        for j, (_, ts, ws) in enumerate(block):
            for t, w in zip(ts, ws, strict=True):
                by_term[number[t]].append((j, w))
        self.size = np.array([len(x) for x in by_term], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.question = np.array([j for x in by_term for j, _ in x], np.int64)
        self.weight = np.array([w for x in by_term for _, w in x])

    def scores(self, found: pa.Array, sizes: np.ndarray, row: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
        """Scores (rows by questions): found[i] is the number of a term, null if no one asks for it, and holds for the next sizes[i]
        of (row, w)."""
        known = np.repeat(pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        hit = np.flatnonzero(known >= 0)
        term, row, w = known[hit], row[hit], w[hit]
        times = self.size[term]
        place = np.repeat(self.first[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        cell = np.repeat(row, times) * len(self.ids) + self.question[place]
        return np.bincount(cell, np.repeat(w, times) * self.weight[place], rows * len(self.ids)).reshape(rows, len(self.ids))

    def hits(self, part: pa.RecordBatch, k: int) -> pa.RecordBatch:
        terms, ws = part.column(1), part.column(2).flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(part.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        scores = self.scores(pc.index_in(terms.flatten(), self.known), np.ones(len(ws), np.int64), row, ws, part.num_rows)
        return _hits(self.ids, part.column(0).to_numpy(zero_copy_only=False), scores, k, True)


def _scorer(sent, k: int):
    """(seg_id, terms, weights) -> hits of the blocks of questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_Block(b) for b in sent.value]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for block in blocks:
                    yield block.hits(batch.slice(at, SLICE_ROWS), k)

    return run


def _block_scorer(sent, k: int, n: int):
    """Rows (block, term, df, seg_ids, tfs, segs, norms, queries) sorted by block, postings() of n segments, of which one a block names
    its segments and one its questions -> hits of these. A task gives those that are among the k best of its question so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_Block(b) for b in sent.value]
        tops = [np.zeros((k, len(b.ids))) for b in blocks]
        for table in _runs(batches):
            queries = _column(table, "queries").flatten().to_numpy(zero_copy_only=False)
            lists = _column(table, "seg_ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            row, tf, segs, norms = (_column(table, name).flatten().to_numpy(zero_copy_only=False) for name in ("seg_ids", "tfs", "segs", "norms"))
            row = row.astype(np.int64)
            terms, idf = _column(table, "term"), _idf(n, pc.fill_null(_column(table, "df"), 0).to_numpy(zero_copy_only=False))
            weights = tf * np.repeat(idf, sizes) / norms[row]
            for block, top in zip(blocks, tops, strict=True):
                asking = np.flatnonzero(np.isin(block.ids, queries))
                if not len(asking) or not len(segs):
                    continue
                scores = block.scores(pc.index_in(terms, block.known), sizes, row, weights, len(segs))[:, asking]
                rounded = np.round(scores, DIGITS) + 0.0
                top[:, asking] = np.partition(np.concatenate([top[:, asking], rounded]), len(rounded), axis=0)[len(rounded) :]
                seg, query = np.nonzero((rounded >= top[:, asking].min(axis=0)) & (rounded > 0))
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[asking[query]], pa.int64()), pa.array(segs[seg], pa.int64()), pa.array(rounded[seg, query])], names=["query_id", "seg_id", "score"])

    return run


def score_blocks(rows: DataFrame, asked: DataFrame, k: int, n: int) -> DataFrame:
    """Hits of the questions asked(query_id, term, w) among rows of _block_scorer(), sorted by block."""
    spark = rows.sparkSession
    hits = spark.createDataFrame([], _HITS)
    for shared in batched(_question_blocks(asked), SHARED_BLOCKS):
        hits = hits.unionByName(rows.mapInArrow(_block_scorer(spark.sparkContext.broadcast(list(shared)), k, n), _HITS))
    return hits


def filled(hits: DataFrame, segments: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The k best of hits(query_id, seg_id, score). A question with fewer hits is filled up with segments of score 0, the
    lowest ids first."""
    # Among the 2k lowest ids at least k are without a hit where fewer than k segments have one.
    lowest = segments.select("seg_id").orderBy("seg_id").limit(2 * k).agg(F.collect_list("seg_id").alias("ids"))
    filler = questions.select("query_id").distinct().select("query_id", F.explode(lowest.scalar()).alias("seg_id"), F.lit(0.0).alias("score"))
    best = top_k(hits, k).drop("rank").unionByName(filler).repartition("query_id", "seg_id").groupBy("query_id", "seg_id").agg(F.max("score").alias("score"))
    return top_k(best, k)


def score_sparse(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Hits of the questions asked(query_id, term, w) among rows(seg_id, terms, weights), the best of each task at least."""
    spark = rows.sparkSession
    hits = spark.createDataFrame([], _HITS)
    for shared in batched(_question_blocks(asked), SHARED_BLOCKS):
        hits = hits.unionByName(rows.mapInArrow(_scorer(spark.sparkContext.broadcast(list(shared)), k), _HITS))
    return hits


def sparse_topk(segments: DataFrame, questions: DataFrame, k: int = 20, ngram_max: int = 1, min_df: int = 1) -> DataFrame:
    """segments(seg_id, text), questions(query_id, text) -> (query_id, seg_id, score, rank)."""
    corpus = spread(segments.select("seg_id", "text"))
    buckets = buckets_for(corpus)
    chunks = kept(coded(corpus, ngram_max, buckets))
    n, total = chunks.agg(F.count("uid"), F.coalesce(F.sum(F.when(F.col("uid").isNotNull(), F.size("places"))), F.lit(0))).first()
    counts = kept(question_terms(questions, ngram_max))
    asked = coded(questions.select(F.col("query_id").alias("seg_id"), "text"), ngram_max, buckets)
    found = kept(frequencies(chunks, asked, min_df))
    vocab = kept(with_idf(known_terms(found), n, min_df))
    rows = segment_weights(chunks, found, n, min_df).select("seg_id", "terms", "weights")
    return filled(score_sparse(rows, weigh(counts, vocab, "query_id", total), k), segments, questions, k)


def _query_blocks(questions: DataFrame, most: int = 2000) -> Iterator[list]:
    block = []
    for row in questions.select("query_id", "embedding").where("embedding IS NOT NULL").toLocalIterator():
        block.append((row[0], list(row[1])))
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block


def dense_topk(vectors: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """vectors(seg_id, embedding), questions(query_id, embedding) -> exact inner products, the k best of each
    question. Every task multiplies its vectors with a block of questions; rows without a vector match nothing."""
    hits = vectors.sparkSession.createDataFrame([], _HITS)
    for block in _query_blocks(questions):
        sent = vectors.sparkSession.sparkContext.broadcast((np.array([q for q, _ in block], np.int64), np.array([v for _, v in block], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    rows = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    yield _hits(ids, part.column(0).to_numpy(zero_copy_only=False), rows @ matrix.T, k, False)

        hits = hits.unionByName(vectors.select("seg_id", "embedding").where("embedding IS NOT NULL").mapInArrow(run, _HITS))
    return top_k(hits, k)


def minmax(hits: DataFrame, score: str = "score") -> DataFrame:
    """Scores of each question scaled over its own hits; all 1 where they don't differ."""
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn("norm", F.round(F.when(high - low < 1e-12, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low)), DIGITS))


def fuse(dense: DataFrame, sparse: DataFrame, config: EngineConfig) -> DataFrame:
    """Weighted sum of both scaled channels; an absent hit counts 0. A union and a sum, so one shuffle. The weights
    have two digits, so two more keep the sums exact."""
    rows = minmax(dense).select("query_id", "seg_id", (F.col("norm") * config.weight_dense).alias("part")).unionByName(minmax(sparse).select("query_id", "seg_id", (F.col("norm") * config.weight_sparse).alias("part")))
    # Dealt out explicitly by both keys: a union of parts that are dealt by question counts as dealt so, and joins above
    # then find a wrong number of partitions.
    return rows.repartition("query_id", "seg_id").groupBy("query_id", "seg_id").agg(F.round(F.sum("part"), DIGITS + 2).alias("score"))


def boost(fused: DataFrame, segments: DataFrame, config: EngineConfig, order: str | None = None) -> DataFrame:
    """The 3 k_fused best, guidelines among them times the boost, ranked anew, the k_fused best. The cut comes
    before the boost: a guideline further down stays out. Of segments with one id the last by the column `order`
    names the type (without one, the greatest type). The cut is stored, so only its segments are grouped."""
    cut = kept(top_k(fused, 3 * config.k_fused).drop("rank"))
    typed = narrowed(segments, cut, "seg_id").groupBy("seg_id").agg((F.max_by("doc_type", order) if order else F.max("doc_type")).alias("doc_type"))
    raised = cut.join(typed, "seg_id").withColumn("score", F.round(F.col("score") * F.when(F.col("doc_type") == "guideline", config.boost).otherwise(1.0), DIGITS + 4))
    return top_k(raised.select("query_id", "seg_id", "score"), config.k_fused)


def hybrid_retrieve(segments: DataFrame, questions: DataFrame, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, config: EngineConfig | None = None) -> DataFrame:
    """(query_id, seg_id, score, rank) through both channels; without vectors the sparse one alone."""
    config = config or EngineConfig()
    sparse = sparse_topk(segments, questions, config.k_sparse)
    dense = dense_topk(vectors, question_vectors, config.k_dense) if vectors is not None else sparse.limit(0)
    return boost(fuse(dense, sparse, config), segments, config)


def theta_gate(hits: DataFrame, questions: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """(query_id, top_score, external): whether a question's best score leaves it to the outside."""
    config = config or EngineConfig()
    top = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    top_score = F.coalesce("best", F.lit(0.0))
    return questions.select("query_id").join(top, "query_id", "left").select("query_id", top_score.alias("top_score"), (top_score <= config.theta).alias("external"))


def tiered_search(hits: DataFrame, k: int = 6, merge_by_score: bool = False) -> DataFrame:
    """hits(query_id, tier, seg_id, score, text) -> the k first of each question. Per tier the 2k best; historical
    ones before realtime ones whatever their scores (unless merge_by_score); of equal 200-character beginnings the
    first stays."""
    per_tier = Window.partitionBy("query_id", "tier").orderBy(F.col("score").desc(), "seg_id")
    near = hits.withColumn("tier_rank", F.row_number().over(per_tier)).where(F.col("tier_rank") <= 2 * k).withColumn("prefix", F.substring("text", 1, 200)).drop("text")
    order = [F.col("score").desc(), F.col("tier"), F.col("seg_id")] if merge_by_score else [F.col("tier"), F.col("tier_rank")]
    once = near.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "prefix").orderBy(*order))).where("copy = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "tier", "seg_id", "score", "rank")
