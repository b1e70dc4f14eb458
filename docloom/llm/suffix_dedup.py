"""Operator 10, exact substring dedup: bytes of repeated 100-byte strings go, the first occurrence stays.

Building one suffix order of a whole corpus takes as many rounds as its longest text has bytes. So the texts
are first cut where equal strings can't be torn apart. Every 100-byte window has a least hash among its
32-byte grams; equal windows have the same, so they meet when runs of windows are dealt by it:

1. Every text is scanned once. Neighbouring windows with one least hash form a piece (100 to 168 bytes). Its row
   has the hash, a digest of its bytes, its document and place, not the bytes. Equal pieces of one task's rows
   collapse right there: all but the first are removed whole and are dealt out evenly, so that a passage of very
   many copies sends a row or so per task to its hash.
2. Rows are dealt by the hash and sorted by (hash, digest, document, place). A hash with one row is done: none
   of its windows repeats (unless the piece holds its least gram twice; then it goes on, too). Of equal pieces all
   but the first are removed whole. Nothing is gathered: rows stream past in their order.
3. Of hashes with several different pieces, the first of each goes on with its bytes. What no other window of the
   hash equals, by a hash of the whole window, is cut away; of parts that are equal then all but the first are removed
   whole, as in 2., until no more can be cut. Suffix order and common prefixes of the rest are built column by column (bwt.py), in as many rounds as a piece has bytes, through sequential files; in a run of suffixes
   that share 100 bytes all but the first start are removed. A hash with more than HOT_PIECES different pieces (a
   common phrase in very many contexts) isn't gathered: its pieces are cut again by the least hash of longer grams,
   64 bytes and in the end whole windows, and go through 1. to 3. anew. Whole windows need no 3.: they are equal or not.
4. Removed ranges are joined to their documents and merged.

Cases: ids are integers or null. A null text is empty; a document under 100 bytes keeps all; a very long one is
scanned whole. The order of documents is doc_id, null last; rows with one doc_id and different texts are different
documents, in the order of a hash of their texts; rows that repeat doc_id and text are one document and get the same
result. Matches never cross documents. Columns named like the new ones are replaced; an empty table gives an empty
one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import repeated_starts
from .common import read_table, slices, store

WIDTH, RUN = 100, 69
#: So many bytes of pieces make one collection at least; a hash is never split over two. A hash with more than
#: HOT_PIECES different pieces goes on to the next gram of GRAMS.
COLLECTION_BYTES, HOT_PIECES, GRAMS = 3 << 18, 2048, (32, 64, 100)
_LAST_ID = (1 << 63) - 1
#: So many rows are collapsed at a time; texts of so many bytes together are scanned side by side.
COLLAPSE, SCAN_BYTES = 200_000, 1 << 15
#: `at` holds the start (from bit 10), whether the piece is to be removed whole (9), whether a window may repeat
#: inside it (8), and its length (8 bits).
_GONE, _INSIDE = 1 << 9, 1 << 8
_ROWS = ("h", "digest", "doc", "ord", "at")
_ROWS_DDL = "h long, digest long, doc long, ord long, at long"


def _key(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    """Document order: the id, then the text's hash."""
    return F.coalesce(docs[doc_id].cast("long"), F.lit(_LAST_ID)), F.xxhash64(F.coalesce(docs[text], F.lit("")))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of every run of gram bytes (a power of two), by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    n, factor = 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while n < gram:
            h = h[:-n] * factor + h[n:]
            factor = factor * factor
            n *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A mixed hash of every run of width bytes."""
    n = len(data) - width + 1
    out, at = np.zeros(max(n, 0), np.uint64), 0
    with np.errstate(over="ignore"):
        for bit in range(width.bit_length() - 1, -1, -1):
            if width >> bit & 1 and n > 0:
                out = (out ^ gram_hashes(data[at : at + n + (1 << bit) - 1], 1 << bit)) * np.uint64(0xD6E8FEB86659FD93)
                out ^= out >> np.uint64(32)
                at += 1 << bit
    return out


def window_minima(h: np.ndarray, span: int) -> np.ndarray:
    """Least of every run of span values."""
    n = 1
    while 2 * n <= span:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    rest = span - n
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def pieces(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hash, start in it, length in bytes, whether a window may repeat inside the piece) of the pieces
    of some texts, which are scanned side by side. With grams as long as windows each window is a piece."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    count = np.maximum(length - width + 1, 0)
    if not count.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    span = width - gram + 1
    raw = np.frombuffer(b"".join(texts), np.uint8)
    grams = window_hashes(raw, gram)
    # Windows within a text: its number, and where they start in all bytes.
    number = np.repeat(np.arange(len(texts)), count)
    base = np.cumsum(length) - length
    at = np.arange(len(number)) + np.repeat(base - (np.cumsum(count) - count), count)
    if span == 1:
        return number, grams[at], at - base[number], np.full(len(at), width), np.zeros(len(at), bool)
    least = window_minima(grams, span)[at]
    starts = np.concatenate([[0], np.flatnonzero((least[1:] != least[:-1]) | (number[1:] != number[:-1])) + 1])
    sizes = np.diff(np.append(starts, len(least)))
    if (sizes > RUN).any():  # long runs are cut
        times = -(-sizes // RUN)
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts = np.repeat(starts, times) + within * RUN
        sizes = np.diff(np.append(starts, len(least)))
    # Equal windows of one piece hold its least gram at two places: those of the grams that are the least of
    # some window and equal the next such gram.
    top = np.full(len(grams) + span - 1, np.iinfo(np.uint64).max)
    top[at + span - 1] = ~least
    top = ~window_minima(top, span)
    places = np.flatnonzero(grams == top)
    twice = np.concatenate([[0], np.cumsum(grams[places[1:]] == grams[places[:-1]])])
    low = np.searchsorted(places, at[starts])
    high = np.searchsorted(places, at[starts] + sizes + span - 1) - 1
    return number[starts], least[starts], (at - base[number])[starts], sizes + width - 1, twice[high] > twice[low]


def _batch(columns, names=_ROWS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64, copy=False)) for c in columns], names=names)


def collapse(h: np.ndarray, digest: np.ndarray, doc: np.ndarray, order: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows with one (h, digest) the first by (doc, order, at) stays as it is, rows that repeat one wholly go, and
    the others are marked to be removed, with a hash of their own place, which deals them evenly."""
    sort = np.argsort(digest, kind="stable")
    same = digest[sort[1:]] == digest[sort[:-1]]
    double = sort[np.append(same, False) | np.insert(same, 0, False)]
    double = double[np.lexsort((at[double], order[double], doc[double], digest[double], h[double]))]
    a, b = double[1:], double[:-1]
    equal = (h[a] == h[b]) & (digest[a] == digest[b])
    repeated = equal & (doc[a] == doc[b]) & (order[a] == order[b]) & (at[a] == at[b])
    gone = a[equal]
    with np.errstate(over="ignore"):
        h = h.copy()
        h[gone] = (doc[gone] ^ order[gone]) * np.int64(0x5851F42D4C957F2D) + at[gone] * np.int64(0x14057B7EF767814F)
    at = at.copy()
    at[gone] |= _GONE
    stay = np.ones(len(h), bool)
    stay[a[repeated]] = False
    return h[stay], digest[stay], doc[stay], order[stay], at[stay]


def collapsed(rows: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Arrays of (h, digest, doc, order, at) collapsed by COLLAPSE rows or so."""
    held: list[tuple[np.ndarray, ...]] = []
    for some in rows:
        held.append(some)
        if sum(len(x[0]) for x in held) >= COLLAPSE:
            yield _batch(collapse(*(np.concatenate(x) for x in zip(*held, strict=True))))
            held = []
    if held:
        yield _batch(collapse(*(np.concatenate(x) for x in zip(*held, strict=True))))


def _scan(width: int, gram: int):
    """(doc, ord, bytes, place of the bytes in their text) -> rows of pieces."""

    def rows(texts: list[bytes], doc: np.ndarray, order: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        digest = xxhash.xxh3_64_intdigest
        number, h, start, size, inside = pieces(texts, width, gram)
        sums = np.fromiter((digest(texts[k][s:e]) for k, s, e in zip(number.tolist(), start.tolist(), (start + size).tolist(), strict=True)), np.uint64, len(h))
        return h.view(np.int64), sums.view(np.int64), doc[number], order[number], (start + place[number] << 10) | (inside * np.int64(_INSIDE)) | size

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            doc, order, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            at = size = 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= SCAN_BYTES or k + 1 == len(texts):
                    if len((some := rows(texts[at : k + 1], doc[at : k + 1], order[at : k + 1], place[at : k + 1]))[0]):
                        yield some
                    at, size = k + 1, 0

    return lambda batches: collapsed(found(batches))


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, digest, doc, ord, at) in that order -> (h or null, doc, ord, at): null for pieces to remove whole,
    else a piece to compare further. A hash's first piece is held back until a second one turns up."""
    last = None  # the last row, and the first piece of its hash while that piece is the only one
    only = None
    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        gone = rows[4] & _GONE > 0
        if gone.any():
            yield _sifted([x[gone] for x in rows], False)
            rows = [x[~gone] for x in rows]
        h, digest, doc, order, at = rows
        if not len(h):
            continue
        before = [np.insert(x[:-1], 0, last[k] if last else ~x[0]) for k, x in enumerate(rows)]
        new_h = h != before[0]
        new_piece = new_h | (digest != before[1])
        again = ~new_piece & (doc == before[2]) & (order == before[3]) & (at == before[4])  # a repeated row of documents
        further = new_piece & ~new_h  # second and later pieces of their hash
        # First pieces go on too where a further one follows.
        heads = np.flatnonzero(new_h)
        group = np.cumsum(new_h) - 1
        with_more = np.zeros(len(heads) + 1, bool)
        with_more[group[further]] = True  # group -1, the hash carried over, is the last entry
        with_more[group[new_h & (at & _INSIDE > 0)]] = True
        if only is not None and with_more[-1]:
            yield _sifted([np.array([x]) for x in only], True)
            only = None
        keep = further.copy()
        keep[heads[with_more[: len(heads)]]] = True
        for chosen, compare in ((keep, True), (~new_piece & ~again, False)):
            if chosen.any():
                yield _sifted([x[chosen] for x in rows], compare)
        if len(heads):
            k = heads[-1]
            only = None if with_more[len(heads) - 1] else [x[k] for x in rows]
        last = [x[-1] for x in rows]


def _sifted(rows: list[np.ndarray], further: bool) -> pa.RecordBatch:
    h, _, doc, order, at = rows
    return pa.RecordBatch.from_arrays([pa.array(h) if further else pa.nulls(len(h), pa.int64()), *map(pa.array, (doc, order, at))], names=["h", "doc", "ord", "at"])


def sifted(rows: DataFrame) -> DataFrame:
    return rows.repartition("h").sortWithinPartitions(*_ROWS).mapInArrow(_sift, "h long, doc long, ord long, at long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, ord, [(place, bytes)], [(h, at)]) -> (h, doc, ord, at, bytes of the piece). Of the document's parts, which
    are sets of windows without any in common, the last that starts at or before a piece holds it."""
    for batch in slices(batches):
        doc, order = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        found = batch.column(3).flatten()
        h, at = (found.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        count = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
        start, end = (at >> 10).tolist(), ((at >> 10) + (at & 0xFF)).tolist()
        data: list[bytes] = []
        for parts, n in zip(batch.column(2).to_pylist(), count.tolist(), strict=True):
            held = sorted((p["place"], p["data"]) for p in parts)
            places = [p for p, _ in held]
            for k in range(len(data), len(data) + n):
                place, raw = held[bisect_right(places, start[k]) - 1]
                data.append(raw[start[k] - place : end[k] - place])
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(doc, count)), pa.array(np.repeat(order, count)), pa.array(at), pa.array(data, pa.binary())], names=["h", "doc", "ord", "at", "data"])


def repeated_part(data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string the first and the last start of a window whose hash occurs twice in all strings (-1 for none)."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    length = np.fromiter(map(len, data), np.int64, len(data))
    base = np.cumsum(length) - length
    count = np.maximum(length - width + 1, 0)
    string = np.repeat(np.arange(len(data)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    h = window_hashes(raw, width)[base[string] + place]
    sort = np.argsort(h, kind="stable")
    same = h[sort[1:]] == h[sort[:-1]]
    hits = np.sort(sort[np.append(same, False) | np.insert(same, 0, False)])
    first, last = np.full(len(data), -1), np.full(len(data), -1)
    last[string[hits]] = place[hits]
    first[string[hits[::-1]]] = place[hits[::-1]]
    return first, last


def distinct_parts(rows: list[tuple], width: int) -> tuple[list[tuple], list[tuple]]:
    """Rows (h, doc, ord, at, data) in the order of documents and places -> (equal, parts). parts are (doc, ord, start,
    bytes), in that order still: of each piece what lies between its first and last window that others repeat, the first of
    equal ones alone. The others (doc, ord, start, end) are removed whole. Without them more windows are single, so this
    goes on until nothing changes."""
    parts = [(doc, order, at >> 10, data) for _, doc, order, at, data in rows]
    equal: list[tuple] = []
    while parts:
        first, last = repeated_part([x[3] for x in parts], width)
        seen: set[bytes] = set()
        left = []
        for k in np.flatnonzero(first >= 0).tolist():
            doc, order, start, data = parts[k]
            start, data = start + int(first[k]), data[first[k] : last[k] + width]
            if data in seen:
                equal.append((doc, order, start, start + len(data)))
            else:
                seen.add(data)
                left.append((doc, order, start, data))
        same = len(left) == len(parts) and all(len(x[3]) == len(y[3]) for x, y in zip(left, parts, strict=True))
        parts = left
        if same:
            break
    return equal, parts


def _compare(width: int, least_bytes: int):
    """Rows (h, doc, ord, at, data) sorted by h -> (doc, ord, s, e), ranges to remove."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[1:4])
        rows = [r for k, r in enumerate(rows) if not k or r[1:4] != rows[k - 1][1:4]]  # repeated rows of documents
        again, parts = distinct_parts(rows, width)
        if again:
            yield _batch(list(zip(*again, strict=True)), ["doc", "ord", "s", "e"])
        if not parts:
            return
        data = [x[3] for x in parts]
        doc, order, start = (np.array([x[c] for x in parts], np.int64) for c in range(3))
        number = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (order[1:] != order[:-1]))])
        found = list(repeated_starts(data, width, (number << 32) + start))
        if not found:
            return
        string, place = (np.concatenate(x) for x in zip(*found, strict=True))
        sort = np.lexsort((place, string))
        string, place = string[sort], place[sort]
        head = np.ones(len(string), bool)
        head[1:] = (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)
        firsts = np.flatnonzero(head)
        final = np.append(firsts[1:], len(string)) - 1
        who = string[firsts]
        yield _batch((doc[who], order[who], start[who] + place[firsts], start[who] + place[final] + width), ["doc", "ord", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if size >= least_bytes and row[0] != held[-1][0]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from solve(held)

    return run


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def removed_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, grams: tuple[int, ...] = GRAMS, least_bytes: int = COLLECTION_BYTES, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """(doc, ord, ranges array<struct<s, e>>): the bytes to remove, for documents that have any; unmerged. The last of
    grams is width."""
    doc, order = _key(docs, doc_id, text)
    keyed = docs.select(doc.alias("doc"), order.alias("ord"), F.encode(F.coalesce(text, F.lit("")), "utf-8").alias("data"))
    start = F.shiftright("at", 10)
    span = [start.alias("s"), (start + F.col("at").bitwiseAND(F.lit(0xFF))).alias("e")]
    source, ranges = keyed.select("doc", "ord", "data", F.lit(0).cast("long").alias("place")), None
    part = F.struct("place", "data")
    parts = source.select("doc", "ord", F.array(part).alias("parts"))
    for gram in grams:
        found = store(sifted(source.mapInArrow(_scan(width, gram), _ROWS_DDL)))
        whole = found.where("h IS NULL").select("doc", "ord", *span)
        ranges = whole if ranges is None else ranges.unionByName(whole)
        if gram == width:
            break
        further = found.where("h IS NOT NULL")
        wanted = further.groupBy("doc", "ord").agg(F.collect_list(F.struct("h", "at")).alias("found"))
        joined = parts.join(wanted, ["doc", "ord"]).select("doc", "ord", "parts", "found")
        cut = store(joined.mapInArrow(_cut, "h long, doc long, ord long, at long, data binary"))
        hot = store(further.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_pieces).select("h"))
        none = hot.limit(1).isEmpty()
        dealt = (cut if none else cut.join(hot, "h", "left_anti")).repartition("h").sortWithinPartitions("h")
        ranges = ranges.unionByName(dealt.mapInArrow(_compare(width, least_bytes), "doc long, ord long, s long, e long"))
        if none:
            break
        # From here on the pieces of hot hashes stand for the texts.
        source = cut.join(hot, "h", "left_semi").select("doc", "ord", "data", start.alias("place")).distinct()
        parts = source.groupBy("doc", "ord").agg(F.collect_list(part).alias("parts"))
    return ranges.groupBy("doc", "ord").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))


def dedup_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with kept_bytes (binary), removed (merged ranges), n_bytes, n_removed, n_spans, kept_sha256."""
    ranges = removed_ranges(docs, doc_id, text, **options)
    doc, order = _key(docs, doc_id, text)
    made = ["kept_bytes", "removed", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kept = [c for c in docs.columns if c not in made]
    joined = docs.select(*kept, doc.alias("__doc"), order.alias("__ord")).join(ranges.select(F.col("doc").alias("__doc"), F.col("ord").alias("__ord"), F.col("ranges").alias("__ranges")), ["__doc", "__ord"], "left")
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for t, found in zip(column[text].to_pylist(), column["__ranges"].to_pylist(), strict=True):
                data, merged = (t or "").encode("utf-8", "surrogatepass"), _merge([(x["s"], x["e"]) for x in found or ()])
                ends = [0, *(e for _, e in merged)]
                rest = b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in merged), len(data)], strict=True))
                rows.append((rest, [{"s": s, "e": e} for s, e in merged], len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.binary(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([column[c] for c in kept] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=kept + made)

    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "kept_bytes binary, removed array<struct<s: bigint, e: bigint>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    return joined.select(*kept, "__ranges").mapInArrow(run, ddl)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_text(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
