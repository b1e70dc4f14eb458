"""Suffix order and common prefixes of a collection of strings, built column by column.

Round j puts the j-th symbol from the end of every string in front of its suffix of length j - 1. The suffixes
so far stand in files in their order, each with the symbol before it (the Burrows-Wheeler transform of the
collection), the length of the prefix it shares with the one above, its string and its place there. A new
suffix starts with the symbol c that stands before the suffix it extends, so it goes to the place
(symbols below c) + (times c occurs above). What it shares with its neighbours there is one more than the least
shared length between the two suffixes they extend. Each round reads the files once from front to end for
these ranks and minima, and once more to write them anew with the new suffixes put in. Only chunks and one
number per symbol and string are held; files over the spool size go to the task's scratch folder, are read by
nobody else, and end with the task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
SPOOL_BYTES = 64 << 20
#: Shared lengths are kept up to this; no caller asks for more.
MOST = 255
_NONE = 256  # more than any kept length


class Rows:
    """A file of rows, written once from front to end, then read so. A row is one 64-bit number: the symbol before
    the suffix (bits 0 to 7; 0 for none), the length shared with the row above (8 to 15), the place of the suffix
    in its string (16 to 31) and the string (32 to 63)."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
        self.count = 0

    def append(self, rows: np.ndarray) -> None:
        self.file.write(memoryview(rows).cast("B"))
        self.count += len(rows)

    def read(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row number, rows) chunk by chunk."""
        self.file.seek(0)
        at = 0
        while at < self.count:
            n = min(CHUNK, self.count - at)
            yield at, np.frombuffer(self.file.read(n * 8), "<u8")
            at += n

    def close(self) -> None:
        self.file.close()


def symbols(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows.view(np.uint8)[0::8])


def shared_lengths(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows.view(np.uint8)[1::8])


def places(rows: np.ndarray) -> np.ndarray:
    return rows.view("<u2")[1::4]


def strings_of(rows: np.ndarray) -> np.ndarray:
    return rows.view("<u4")[1::2]


def _packed(symbol: np.ndarray, shared: np.ndarray, place: np.ndarray, string: np.ndarray) -> np.ndarray:
    return (string.astype(np.uint64) << np.uint64(32)) | (place.astype(np.uint64) << np.uint64(16)) | (shared.astype(np.uint64) << np.uint64(8)) | symbol.astype(np.uint64)


def _ranks(table: Rows, at: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the suffixes in rows `at` (ascending): the rank of the suffix that extends each by the symbol before
    it, the length shared with the suffix above and below there, and whether there is one below with that symbol.
    below: how many symbols are less, by symbol."""
    n = len(at)
    rank, up, down, has_down = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    seen = np.zeros(256, np.int64)
    since = np.full(256, _NONE, np.int64)  # least shared length after the last row with the symbol
    waiting = np.full(256, -1, np.int64)  # the extended suffix that waits for the symbol's next row
    several = table.count > CHUNK
    done = 0
    for first, rows in table.read():
        size = len(rows)
        symbol, shared = symbols(rows), shared_lengths(rows)
        order = np.argsort(symbol, kind="stable").astype(np.int32)
        count = np.bincount(symbol, minlength=256)
        starts = np.cumsum(count) - count
        least = np.minimum.accumulate(shared) if several else None
        if several:  # suffixes from earlier chunks meet the next row with their symbol
            present = np.flatnonzero(count)
            met = present[waiting[present] >= 0]
            heads = order[starts[met]]
            down[waiting[met]] = np.minimum(since[met], least[heads]) + 1
            has_down[waiting[met]] = True
            waiting[met] = -1
        upto = done + int(np.searchsorted(at[done:], first + size, "left"))
        if upto > done:
            mine = slice(done, upto)
            p = at[mine] - first
            inverse = np.empty(size, np.int32)
            inverse[order] = np.arange(size, dtype=np.int32)
            k, c = inverse[p].astype(np.int64), symbol[p]
            rank[mine] = below[c] + seen[c] + k - starts[c]
            inside = k > starts[c]
            before = order[np.maximum(k - 1, 0)].astype(np.int64)
            value = np.where(seen[c] > 0, np.minimum(since[c], least[p]) + 1, 0) if several else np.zeros(len(p), np.int64)
            value[inside] = _range_min(shared, before[inside] + 1, p[inside] + 1) + 1
            up[mine] = value
            inside = k + 1 < starts[c] + count[c]
            after = order[np.minimum(k + 1, size - 1)].astype(np.int64)
            value = np.zeros(upto - done, np.int64)
            value[inside] = _range_min(shared, p[inside] + 1, after[inside] + 1) + 1
            down[mine] = value
            has_down[mine] = inside
            waiting[c[~inside]] = np.arange(done, upto)[~inside]
            done = upto
        if several:  # the least shared length after each symbol's last row, for the next chunks
            tail = np.append(np.minimum.accumulate(shared[::-1])[::-1], _NONE)
            since = np.minimum(since, least[-1])
            since[present] = tail[order[starts[present] + count[present] - 1] + 1]
        seen += count
    return rank, np.minimum(up, MOST), np.minimum(down, MOST), has_down


def _range_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of values[start:end] for each pair; no range is empty."""
    if not len(start):
        return np.zeros(0, np.int64)
    edges = np.empty(2 * len(start), np.int64)
    edges[::2], edges[1::2] = start, end
    padded = np.append(values, values[-1:])
    return np.minimum.reduceat(padded, edges)[::2].astype(np.int64)


def _inserted(old: Rows, number: np.ndarray, new: np.ndarray, below_number: np.ndarray, below_value: np.ndarray) -> Rows:
    """old with the new rows at their numbers (ascending, counted in the result); then the rows below_number get
    below_value as shared length."""
    out = Rows()
    put = 0
    for first, rows in old.read():
        size, last = len(rows), first + len(rows) >= old.count
        # New rows of which put came before stand at number - (how many were put before) in the old count.
        ahead = number[put:] - np.arange(put, len(number))
        n = len(number) - put if last else int(np.searchsorted(ahead, first + size, "left"))
        start, total = first + put, size + n
        is_old = np.ones(total, bool)
        at = number[put : put + n] - start
        is_old[at] = False
        merged = np.empty(total, "<u8")
        merged[is_old] = rows
        merged[at] = new[put : put + n]
        a, b = np.searchsorted(below_number, [start, start + total])
        merged.view(np.uint8)[1::8][below_number[a:b] - start] = below_value[a:b]
        out.append(merged)
        put += n
    old.close()
    return out


def suffix_order(strings: list[bytes]) -> Rows:
    """Rows of all suffixes in order. Strings are under 65,536 bytes, none is empty, and they have no more than 255
    different bytes (UTF-8 has 243); bytes become symbols in their order. The first rows, one per string, are the
    empty suffixes."""
    m = len(strings)
    length = np.fromiter(map(len, strings), np.int64, m)
    raw = np.frombuffer(b"".join(strings), np.uint8)
    used = np.bincount(raw, minlength=256) > 0
    if used.all():
        raise ValueError("more than 255 different bytes")
    text = np.cumsum(used).astype(np.uint8)[raw]  # 1 for the least byte used
    base = np.cumsum(length) - length
    table = Rows()
    everyone = np.arange(m)
    symbol = text[base + length - 1]
    table.append(_packed(symbol, np.zeros(m), length, everyone))
    counts = np.bincount(symbol, minlength=256)
    at, who, place = everyone, everyone, length.copy()  # rows, strings and places of the latest suffixes
    while len(who):
        below = np.cumsum(counts) - counts - counts[0]
        rank, up, down, has_down = _ranks(table, at, below)
        rank += m
        order = np.argsort(rank, kind="stable")
        number, who, place, up, down, has_down = rank[order], who[order], place[order] - 1, up[order], down[order], has_down[order]
        symbol = np.where(place > 0, text[base[who] + np.maximum(place, 1) - 1], 0)
        table = _inserted(table, number, _packed(symbol, up, place, who), number[has_down] + 1, down[has_down])
        counts = counts + np.bincount(symbol, minlength=256)
        going = place > 0
        at, who, place = number[going], who[going], place[going]
    return table


def repeated_starts(strings: list[bytes], width: int, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(string, place) of every start of a width-byte run of bytes that the collection also holds at a lower
    rank; first[string] + place is the rank of a start. width is at most 255."""
    table = suffix_order(strings)
    lowest, low_string, low_place = None, None, None  # of the group that may run on into the next chunk
    for _, rows in table.read():
        string, place = strings_of(rows).astype(np.int64), places(rows).astype(np.int64)
        rank = first[string] + place
        is_head = shared_lengths(rows) < width
        group = np.cumsum(is_head)
        starts = np.flatnonzero(is_head)
        if not is_head[0]:
            starts = np.concatenate([[0], starts])
            group = group + 1
        group = group - 1
        least = np.minimum.reduceat(rank, starts)
        if not is_head[0] and lowest is not None:
            if lowest <= least[0]:
                least[0] = lowest
            else:  # the one held back as lowest isn't
                yield np.array([low_string]), np.array([low_place])
        repeated = rank != least[group]
        if repeated.any():
            yield string[repeated], place[repeated]
        lowest = least[-1]
        k = int(starts[-1]) + int(np.argmin(rank[starts[-1] :]))
        if rank[k] == lowest:
            low_string, low_place = int(string[k]), int(place[k])
    table.close()
