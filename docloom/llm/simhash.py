"""Operator 3, SimHash near-dedup with pigeonhole blocks.

Fingerprints are made batch by batch from whole texts. Equal fingerprints collapse first (combined before the
shuffle), so copies cost nothing further. The 64 bits form seven blocks; two fingerprints that differ in four
bits or fewer share three whole blocks at least, so for each of the 35 choices of three blocks the
fingerprints are dealt by those blocks' bits, and distances are verified among those that meet.

A bucket is never expanded into all its pairs. Small buckets are compared pair by pair; in larger ones a search
walks from fingerprint to fingerprint and drops what it has reached, so a dense group costs one step per
member; only links of a spanning star leave the task. A bucket of more than HOT distinct fingerprints isn't
gathered at all: its rows go to a next level, where the bits still free are split into seven blocks again
and dealt by three of these as well. A level leaves 4/7 of the free bits, so at the fourth a bucket has
12 free bits and 4096 distinct members at most. Nothing is capped or dropped.

Cases: null and empty texts and texts of white space have fingerprint 0 and link like any other; a null id
never names a component unless all members lack one; repeated rows come out once per row; texts of any length are
read whole; columns named fp, component_id, __least or root are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, slices
from .components import components

SEED = 42
RADIUS, BLOCKS, HOT, FEW_BITS = 4, 7, 4096, 12


#: Places of a hash's eight bytes in a table of counts by value, and the bits of each value.
_LANES = np.arange(8) << 8
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of width words joined by spaces; of the whole sequence if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - width + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is in over half the hashes; unsigned."""
    total = np.zeros(64)
    for at in range(0, len(hashes), 1 << 16):
        lanes = hashes[at : at + (1 << 16)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8) + _LANES
        total += (np.bincount(lanes.ravel(), minlength=8 << 8).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4, column: str = "fp") -> DataFrame:
    """docs without text but with the fingerprint as a signed long."""
    kept = [c for c in docs.columns if c not in (text, column)]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            made = np.array([fingerprint(shingle_hashes(words_of(t), width)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(made)], names=[*kept, column])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"{column} long"]))


def block_masks(free: int, blocks: int = BLOCKS, whole: int = BLOCKS - RADIUS) -> list[int]:
    """Masks of every choice of `whole` of the blocks into which the bits set in free are split."""
    bits = [i for i in range(64) if free >> i & 1]
    parts = [sum(1 << i for i in bits[k::blocks]) for k in range(blocks)]
    return [sum(c) for c in combinations(parts, whole)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_bucket(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (member, start) of every group that distances of radius or less tie together, in one bucket of
    distinct values. The search drops what it has reached."""
    out = []
    rest = values
    while len(rest) > 1:
        start, rest = rest[0], rest[1:]
        queue = [start]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                out.extend((int(x), int(start)) for x in found)
                queue.extend(found)
    return out


def _close_pairs(run: np.ndarray, fp: np.ndarray, small: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within radius in the runs of equal numbers (no run is longer than small)."""
    left, right = [fp[:0]], [fp[:0]]
    for lag in range(1, min(small, len(fp))):
        at = np.flatnonzero(run[lag:] == run[:-lag])
        if not len(at):
            break
        at = at[np.bitwise_count(fp[at + lag] ^ fp[at]) <= radius]
        left.append(fp[at + lag])
        right.append(fp[at])
    return np.concatenate(left), np.concatenate(right)


def _with_last(batches):
    for batch in batches:
        yield False, batch
    yield True, None


def _linker(hot: int, radius: int, blocks: int, small: int = 12):
    """mapInArrow function over rows (mask, bits, fp) sorted by bucket (mask, bits). Gives links (u, v, null) and,
    for each bucket that is too large, its members (u, null, mask) under every mask of the next level."""

    def table(u: np.ndarray, v: np.ndarray | None, mask: int = 0) -> pa.RecordBatch:
        n, nothing = len(u), pa.nulls(len(u), pa.int64())
        left = pa.array(np.asarray(u, np.uint64).view(np.int64))
        if v is None:
            return pa.RecordBatch.from_arrays([left, nothing, pa.array(np.full(n, _signed(mask)))], names=["u", "v", "mask"])
        return pa.RecordBatch.from_arrays([left, pa.array(np.asarray(v, np.uint64).view(np.int64)), nothing], names=["u", "v", "mask"])

    def later(fp: np.ndarray, mask: int) -> Iterator[pa.RecordBatch]:
        for more in block_masks(~mask & (1 << 64) - 1, blocks, blocks - radius):
            yield table(fp, None, mask | more)

    def too_large(n: int, mask: int) -> bool:
        return n > hot and 64 - mask.bit_count() > FEW_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = bits = fp = np.empty(0, np.uint64)
        passing = None
        for last, batch in _with_last(batches):
            if batch is not None:
                new = [batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(3)]
                mask, bits, fp = (np.concatenate(x) for x in zip((mask, bits, fp), new, strict=True))
            if passing is not None:  # the rest of a bucket that is too large goes by
                other = np.flatnonzero((mask != passing[0]) | (bits != passing[1]))
                n = int(other[0]) if len(other) else len(fp)
                yield from later(fp[:n], passing[0])
                mask, bits, fp = mask[n:], bits[n:], fp[n:]
                if not len(fp):
                    continue
                passing = None
            if not len(fp):
                continue
            starts = np.concatenate([[0], np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1])
            whole = len(fp) if last else int(starts[-1])
            sizes = np.diff(np.append(starts, len(fp)))
            if not last:
                starts, sizes = starts[:-1], sizes[:-1]
            number = np.repeat(np.arange(len(sizes)), sizes)
            few = np.repeat((sizes > 1) & (sizes <= small), sizes)
            u, v = _close_pairs(number[few], fp[:whole][few], small, radius)
            if len(u):
                yield table(u, v)
            for at, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
                if too_large(n, int(mask[at])):
                    yield from later(fp[at : at + n], int(mask[at]))
                elif found := link_bucket(fp[at : at + n], radius):
                    yield table(*(np.array(x, np.uint64) for x in zip(*found, strict=True)))
            mask, bits, fp = mask[whole:], bits[whole:], fp[whole:]
            if len(fp) and too_large(len(fp), int(mask[0])):
                passing = int(mask[0]), int(bits[0])
                yield from later(fp, passing[0])
                mask = bits = fp = fp[:0]

    return run


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT, blocks: int = BLOCKS) -> DataFrame:
    """distinct(fp) -> links(u, v) whose components are those of all pairs within radius."""
    masks = [_signed(m) for m in block_masks((1 << 64) - 1, blocks, blocks - radius)]
    rows = distinct.select(F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"), "fp")
    out = None
    while True:
        dealt = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("bits"), "fp").repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")
        made = materialize(dealt.mapInArrow(_linker(hot, radius, blocks), "u long, v long, mask long"))
        found = made.where("mask IS NULL").select("u", "v")
        out = found if out is None else out.unionByName(found)
        rows = made.where("mask IS NOT NULL").select("mask", F.col("u").alias("fp"))
        if rows.limit(1).isEmpty():
            return out


def cluster(prints: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """prints(doc_id, fp, ...) with component_id, the least doc_id of all that links lead to."""
    by_print = materialize(prints.groupBy("fp").agg(F.min(doc_id).alias("__least")))
    reach = components(links(by_print.select("fp"), radius, hot))
    roots = by_print.join(reach.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Written first, so that the join meets plain shuffles, whose hot keys the adaptive join can split.
    least = materialize(roots.groupBy("root").agg(F.min("__least").alias("component_id")))
    named = roots.join(least, "root").select("fp", "component_id")
    return prints.drop("component_id", "__least", "root").join(named, "fp")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(fingerprints(read_table(spark, sf_dir, "documents", "doc_id", "text")))
    return cluster(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
