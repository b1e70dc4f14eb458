"""Operator 2, benchmark decontamination by SimHash windows of the items' sizes.

Words of documents and items are compared in lower case, without ASCII punctuation. For every item, windows of
as many words as the item has are fingerprinted and looked up in a multi-index: the 64 bits form seven blocks,
each of which lists the items within two bits of every value it can take. A fingerprint within RADIUS (20) of an
item's is within two bits of it in one block at least, so the lookup misses none. A document shorter than the item
is itself its one window. Candidates are verified by the
weighted Jaccard similarity of five-word shingles (a shingle weighs as often as it occurs; an item of fewer
words is one shingle), and count from SIMILARITY (0.8) on.

A window that shares no shingle with any item of its size has similarity 0 to them, so only windows around
shared shingles are fingerprinted; that leaves results as they are. Items are a query set: they go out in blocks of bounded size
(ITEMS_PER_BLOCK, BYTES_PER_BLOCK), each block against all documents; no document is shuffled.

Cases: null or empty texts and items without a word match nothing; repeated items give a row each; repeated
rows of documents come out once per row; the best window of a document and item counts, the first among equals;
texts of any length are read whole; empty tables of documents or items give no match; ids may be of any type, null,
too; a column __found of the documents is replaced.

The radius isn't a guarantee of the similarity: on the test tables all matches of 0.8 or more (sf0.1: 245, check_s:
1335) are equal to their items, at distance 0; of items of 15 to 60 words with words changed so that the similarity is
0.8 or more, the tests hold the share within the radius over 0.98.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import read_table, slices
from .simhash import SEED

SHINGLE, SIMILARITY, RADIUS, BLOCKS, FLIPS = 5, 0.8, 20, 7, 2
#: Words whose hashes are made in one go, and the longest that are taken byte by byte.
LINE_WORDS, LONGEST = 4096, 64
ITEMS_PER_BLOCK, BYTES_PER_BLOCK = 5_000, 8 << 20
#: Powers of an odd number and of its inverse, modulo 2 ** 64.
_POWERS, _INVERSE = (np.multiply.accumulate(np.array([1] + [x] * (LINE_WORDS * (LONGEST + 1)), np.uint64)) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * 32 + b"abcdefghijklmnopqrstuvwxyz")


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()


def _line(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the words with spaces between them, and where each word starts and ends."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    spaces = np.flatnonzero(data == 32)
    return data, np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(data)]))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash for every word (none has a space), from the word alone. It is a polynomial in the word's bytes, made from sums
    over the whole line; words of more than LONGEST bytes are replaced by their XXH64."""
    out = np.zeros(len(words), np.uint64)
    for at in range(0, len(words), LINE_WORDS):
        data, starts, ends = _line(words[at : at + LINE_WORDS])
        if (ends - starts).max() > LONGEST:
            data, starts, ends = _line([w if len(w) <= LONGEST else xxhash.xxh64_hexdigest(w, SEED).encode() for w in words[at : at + LINE_WORDS]])
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=sums[1:])
        out[at : at + LINE_WORDS] = (sums[ends] - sums[starts]) * _INVERSE[starts]
    return mixed(out)


def word_hash(word: bytes) -> int:
    return int(word_hashes([word])[0])


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the numbers spread over all bits."""
    h = h ^ h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def shingles(words: list[bytes], width: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """A hash for every run of width words (of them all if there are fewer), from the words' hashes."""
    h = word_hashes(words) if hashes is None else hashes
    width = min(width, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        return mixed(out)


def simhashes(hashes: np.ndarray, count: int) -> np.ndarray:
    """SimHash of every run of count shingle hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[count:] - sums[:-count]) > count, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class MultiIndex:
    """Fingerprints of items by the values of their blocks and what is within FLIPS bits of those."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        edges = np.linspace(0, 64, BLOCKS + 1).astype(int)
        self.blocks = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            width = int(high - low)
            flips = [0] + [sum(1 << i for i in c) for k in range(1, FLIPS + 1) for c in combinations(range(width), k)]
            value = (prints >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
            keys = (value[:, None] ^ np.array(flips)[None, :]).ravel()
            items = np.repeat(np.arange(len(prints)), len(flips))
            order = np.argsort(keys, kind="stable")
            self.blocks.append((np.uint64(low), (1 << width) - 1, np.searchsorted(keys[order], np.arange((1 << width) + 1)), items[order]))

    def within(self, fingerprint: int) -> np.ndarray:
        """Items whose fingerprints differ in RADIUS bits or fewer."""
        found = [items[starts[v] : starts[v + 1]] for low, mask, starts, items in self.blocks for v in [int(fingerprint >> int(low)) & mask]]
        found = np.unique(np.concatenate(found))
        return found[np.bitwise_count(self.prints[found] ^ np.uint64(fingerprint)) <= RADIUS]


class Items:
    """A block of items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str]]):
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        sizes: dict[int, dict[int, set[int]]] = {}
        for number, (_, text) in enumerate(rows):
            words = tokens(text)
            if words:
                h = shingles(words, SHINGLE)
                by_size.setdefault(len(words), []).append((number, h))
                of_width = sizes.setdefault(min(SHINGLE, len(words)), {})
                for x in h.tolist():
                    of_width.setdefault(x, set()).add(len(words))
        self.ids = [i for i, _ in rows]
        #: By shingle width: the shingles of items, sorted, and for each the sizes of the items that have it.
        self.known = {w: (np.array(sorted(x), np.uint64), [sorted(x[h]) for h in sorted(x)]) for w, x in sizes.items()}
        self.index = {n: (np.array([i for i, _ in x]), MultiIndex(np.array([simhashes(h, len(h))[0] for _, h in x], np.uint64)), [Counter(h.tolist()) for _, h in x]) for n, x in by_size.items()}

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item number, similarity, first word, words) of each item found: its best window."""
        words = tokens(text)
        best: dict[int, tuple[float, int, int]] = {}
        for width, (known, sizes) in self.known.items():
            if len(words) < width:
                continue
            h = shingles(words, width)
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            hits = np.flatnonzero(known[at] == h)
            by_size: dict[int, list[int]] = {}
            for hit in hits.tolist():
                for n in sizes[at[hit]]:
                    by_size.setdefault(n, []).append(hit)
            for n, places in by_size.items():
                self._windows(h, np.array(places), n, min(n, len(words)) - width + 1, best)
        return [(i, *x) for i, x in sorted(best.items())]

    def _windows(self, h: np.ndarray, hits: np.ndarray, n: int, count: int, best: dict[int, tuple[float, int, int]]) -> None:
        """Look up every window of count shingles that holds one of the hits, among the items of n words."""
        numbers, index, counters = self.index[n]
        lows, highs = np.maximum(hits - count + 1, 0), np.minimum(hits, len(h) - count)
        cuts = np.flatnonzero(lows[1:] > highs[:-1] + 1)
        for low, high in zip(lows[np.append(0, cuts + 1)].tolist(), highs[np.append(cuts, len(highs) - 1)].tolist(), strict=True):
            part = h[low : high + count]
            for k, fp in enumerate(simhashes(part, count).tolist()):
                for j in index.within(fp).tolist():
                    s = similarity(Counter(part[k : k + count].tolist()), counters[j])
                    number = int(numbers[j])
                    if s >= SIMILARITY and (number not in best or s > best[number][0]):
                        best[number] = s, low + k, count + min(SHINGLE, n) - 1


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded number and size, streamed to the driver one partition at a time."""
    block, size = [], 0
    for row in items.select(item_id, text).toLocalIterator():
        block.append((row[0], row[1] or ""))
        size += len(row[1] or "")
        if len(block) >= ITEMS_PER_BLOCK or size >= BYTES_PER_BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _with_matches(docs: DataFrame, block: list[tuple], text: str, id_type) -> DataFrame:
    """docs with __found, the array of (item, similarity, first word, words) found of one block."""
    docs = docs.drop("__found")
    types = dict(docs.dtypes)
    kind = pa.list_(pa.struct([("item", to_arrow_type(id_type)), ("similarity", pa.float64()), ("first", pa.int64()), ("words", pa.int64())]))
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in docs.columns), f"__found array<struct<item: {id_type.simpleString()}, similarity: double, first: bigint, words: bigint>>"])
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Items(sent.value)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [[{"item": own.ids[i], "similarity": s, "first": f, "words": n} for i, s, f, n in own.matches(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "__found"])

    return docs.mapInArrow(run, ddl)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) for every document and item with a matching window."""
    out = None
    kind = items.schema[item_id].dataType
    for block in item_blocks(items, item_id, text):
        part = _with_matches(docs.select(doc_id, text), block, text, kind)
        part = part.where(F.size("__found") > 0).select(doc_id, F.explode("__found").alias("x")).select(doc_id, F.col("x.item").alias(item_id), "x.similarity", F.col("x.first").alias("first_word"), F.col("x.words").alias("n_words"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"{doc_id} {dict(docs.dtypes)[doc_id]}, {item_id} {kind.simpleString()}, similarity double, first_word long, n_words long")
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """docs without those that hold a window matching any item; block by block, no shuffle."""
    columns = [c for c in docs.columns if c != "__found"]
    for block in item_blocks(items, item_id, text):
        docs = _with_matches(docs, block, text, items.schema[item_id].dataType).where(F.size("__found") == 0).select(*columns)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak; similarities are rounded to six places."""
    found = find_leaks(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.withColumn("similarity", F.round("similarity", 6))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
