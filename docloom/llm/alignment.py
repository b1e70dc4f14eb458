"""Operator 11, cross-tokenizer alignment by a dictionary of groups.

Two tokenizers cut the same bytes. Where tokens of both end, the text is cut into groups, each with the A ids and B ids of its
bytes; every A id of a group is linked to every B id. Few distinct groups make up a corpus, so links are expanded once
for each distinct group, never for an occurrence:

1. A task keeps a dictionary of the groups it meets (with small numbers of its own) for a chunk of documents. It sends each
   document as the numbers and frequencies of its groups, and each group of the chunk once, with the number of documents that
   have it. A document in which several groups hold the same id pair would count that often for the pair; what is too
   much goes out as a row of its own, under the pair's key, with a negative count.
2. The distinct groups of all chunks, with their summed documents, are expanded to id pairs; the sums by pair are the numbers of
   documents that hold it linked. Each group gets the sum of the counts of its links, and the number of those that are best
   for their A id.
3. These values go back by group key to the chunks' dictionaries (a frequent group is one row for each chunk, not for each
   document), and in each chunk to the documents, by number and frequency.

Tokenizing: both vocabularies are known not to merge across a border between a character and white space after it (those
white space characters that a B piece does attach to another character are left out of the borders, and every
border is checked), so a text is cut there and each distinct unit of a chunk is encoded once. Units go to the libraries joined.

Cases: null and empty texts have no tokens, nor have those whose joined token bytes differ from space+text (such as texts with U+2581);
rows stand for themselves, so null and repeated ids and ties need no rule; an empty table gives an empty one; columns beside doc_id and
text aren't read; texts of any length are aligned whole; a group of any length counts each pair of its distinct ids once,
with the product of their frequencies.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters, default_vocabulary
from .common import KEPT, materialize, read_table, slices, store, temporary_stores

#: A chunk ends when it has so many documents, groups or units, whichever comes first.
CHUNK_DOCUMENTS, CHUNK_GROUPS, CHUNK_UNITS = 4096, 1 << 17, 1 << 18
#: Characters of texts that are encoded together.
TOGETHER = 1 << 20
#: Characters whose class is the same for every version of Unicode and every library; other units take the slow way.
_PLAIN = re.compile(r"[\t-\r -~À-ɏ]*\Z")
#: The byte-level pre-tokenizer's pattern (a fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SEPARATOR = b"\xff\xff\xff\xff"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Numbered(dict):
    """Numbers for keys in the order in which they turn up; fresh holds those since it was last emptied."""

    def __init__(self) -> None:
        self.fresh: list = []

    def __missing__(self, key):
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


class Tokenizers:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, vocabulary: str, model: bytes):
        import sentencepiece
        import tiktoken

        of_char = byte_characters()
        parsed = json.loads(vocabulary)
        special = {x["id"] for x in parsed.get("added_tokens", ())}
        self.vocabulary = vocabulary
        a = {i: bytes(of_char[c] for c in text) for text, i in parsed["model"]["vocab"].items() if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks={text: i for i, text in a.items()}, special_tokens={})
        self.slow = None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        texts = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        b = {i: bytes([int(t[3:-1], 16)]) if self.pieces.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)}
        self.bytes_a, self.bytes_b = ([x.get(i, b"") for i in range(max(x) + 1)] for x in (a, b))
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        attached = {y for i, t in enumerate(texts) if not self.pieces.is_byte(i) for x, y in zip(t, t[1:]) if y.isspace() and not x.isspace()}
        if any(y == "▁" and x != "▁" and not x.isspace() for t in texts for x, y in zip(t, t[1:])):
            raise ValueError("pieces that end in a space aren't supported")
        more = f"(?:[{re.escape(''.join(sorted(attached)))}]\\s*\\S*)*" if attached else ""
        self.units = re.compile(rf"\s*\S+{more}|\s+")

    def ids_a(self, unit: str, plain: bool) -> list[int]:
        if plain:
            return self.fast.encode_ordinary(unit)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.vocabulary)
            self.slow.encode_special_tokens = True
            self.slow.no_truncation()
            self.slow.no_padding()
        return self.slow.encode(unit, add_special_tokens=False).ids

    def ids_b(self, units: str) -> list[int]:
        """The ids of a text that begins with white space. The letter before it stops the space that is added."""
        return self.pieces.encode("a" + units, num_threads=1)[1:]


@lru_cache(maxsize=1)
def tokenizers(vocabulary: str, model: bytes) -> Tokenizers:
    return Tokenizers(vocabulary, model)


KEPT["alignment"] = tokenizers.cache_clear


class Rows:
    """Rows of numbers, end to end: numbers, and where each row ends."""

    def __init__(self) -> None:
        self.flat, self.ends = array("i"), array("q", [0])

    def add(self, row) -> None:
        self.flat.extend(row)
        self.ends.append(len(self.flat))

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows in order, and their sizes."""
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.int32) if self.flat else np.empty(0, np.int32)
        starts = ends[which]
        sizes = ends[which + 1] - starts
        before = np.cumsum(sizes) - sizes
        return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))], sizes


class Chunk:
    """What a task keeps of a chunk of documents."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.units, self.groups, self.pairs = Numbered(), Numbered(), Numbered()
        self.unit_groups, self.group_pairs = Rows(), Rows()
        self.wrong: set[int] = set()
        self.written: list[str] = []
        self.sizes: list[tuple[int, int]] = []
        self.holders: Counter[int] = Counter()
        self.excess: Counter[int] = Counter()
        self.documents = 0

    def full(self) -> bool:
        return self.documents >= CHUNK_DOCUMENTS or len(self.groups) >= CHUNK_GROUPS or len(self.units) >= CHUNK_UNITS

    def encode_fresh(self) -> None:
        """Groups of the units that are new."""
        fresh, self.units.fresh = self.units.fresh, []
        joined: list[str] = []
        for unit in fresh:
            if _PLAIN.match(unit) and not unit[-1].isspace():
                joined.append(unit)
            else:
                self._encode(joined, True)
                self._encode([unit], False)
                joined = []
        self._encode(joined, True)
        for group in self.groups.fresh:
            a, b = (np.frombuffer(x, "<i4").tolist() for x in self._halves(group))
            self.written.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
            self.sizes.append((len(a), len(b)))
            self.group_pairs.add([self.pairs[x, y] for x in dict.fromkeys(a) for y in dict.fromkeys(b)])
        self.groups.fresh = []
        self.pairs.fresh = []

    @staticmethod
    def _halves(group: bytes) -> tuple[bytes, bytes]:
        at = 0
        while group[at : at + 4] != _SEPARATOR:
            at += 4
        return group[:at], group[at + 4 :]

    def _encode(self, units: list[str], plain: bool) -> None:
        if not units:
            return
        both, text = self.both, "".join(units)
        raw = text.encode()
        a, b = both.ids_a(text, plain), both.ids_b(text)
        if b"".join(map(both.bytes_a.__getitem__, a)) != raw or b"".join(map(both.bytes_b.__getitem__, b)) != raw:
            if len(units) > 1:
                for unit in units:
                    self._encode([unit], False)
            else:
                self.wrong.add(len(self.unit_groups.ends) - 1)
                self.unit_groups.add([])
            return
        a, b = np.array(a, "<i4"), np.array(b, "<i4")
        ends_a, ends_b = np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ends = np.cumsum([len(u) for u in units] if text.isascii() else [len(u.encode()) for u in units])
        last = np.searchsorted(cuts, ends)
        if not np.array_equal(cuts[last], ends):
            raise ValueError("a token crosses a border before white space")
        to_a, to_b = ((np.searchsorted(x, cuts) + 1) * 4 for x in (ends_a, ends_b))
        from_a, from_b = (np.concatenate(([0], x[:-1])) for x in (to_a, to_b))
        raw_a, raw_b, number = a.tobytes(), b.tobytes(), self.groups
        found = [number[raw_a[i:j] + _SEPARATOR + raw_b[k:m]] for i, j, k, m in zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist())]
        at = 0
        for end in (last + 1).tolist():
            self.unit_groups.add(found[at:end])
            at = end

    def add(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, numbers, frequencies) of each text."""
        number, split = self.units.__getitem__, self.both.units.findall
        own = [np.array(list(map(number, split(" " + t))), np.int64) if t and "▁" not in t else np.empty(0, np.int64) for t in texts]
        self.encode_fresh()
        if self.wrong:
            wrong = np.array(sorted(self.wrong))
            own = [u[:0] if np.isin(u, wrong).any() else u for u in own]
        self.documents += len(texts)
        sequence, sizes = self.unit_groups.gather(np.concatenate(own))
        unit_ends = np.concatenate(([0], np.cumsum(sizes)))
        text_ends = unit_ends[np.cumsum([len(u) for u in own])].tolist()
        each = np.array(self.sizes, np.int64).reshape(-1, 2)
        rows, at = [], 0
        for end in text_ends:
            groups = sequence[at:end]
            at = end
            if not len(groups):
                rows.append((0, 0, 0, 0, "", [], []))
                continue
            n_a, n_b = each[groups].T
            distinct, times = np.unique(groups, return_counts=True)
            self.holders.update(distinct.tolist())
            pairs, _ = self.group_pairs.gather(distinct.astype(np.int64))
            if len(pairs) > len(distinct):  # else all groups are of one pair each
                held, often = np.unique(pairs, return_counts=True)
                for pair, n in zip(held[often > 1].tolist(), often[often > 1].tolist()):
                    self.excess[pair] += n - 1
            digest = hashlib.sha256(";".join(map(self.written.__getitem__, groups.tolist())).encode()).hexdigest()
            rows.append((int(n_a.sum()), int(n_b.sum()), len(groups), int((n_a * n_b).sum()), digest, distinct.astype(np.int32), times.astype(np.int32)))
        return rows

    def dictionary(self) -> Iterator[tuple[int | None, str, int]]:
        """(number, key, documents) of each group, and (None, key of the pair, minus what was counted too often)."""
        for number, key in enumerate(self.written):
            yield number, key, self.holders[number]
        pairs = list(self.pairs)
        for pair, n in self.excess.items():
            a, b = pairs[pair]
            yield None, f"{a}|{b}", -n


_COLUMNS = (
    ("chunk", pa.int64(), "long"), ("doc_id", None, ""), ("n_a", pa.int64(), "long"), ("n_b", pa.int64(), "long"), ("n_groups", pa.int64(), "long"), ("n_links", pa.int64(), "long"),
    ("groups_sha256", pa.string(), "string"), ("numbers", pa.list_(pa.int32()), "array<int>"), ("times", pa.list_(pa.int32()), "array<int>"),
    ("number", pa.int32(), "int"), ("key", pa.string(), "string"), ("docs", pa.int64(), "long"),
)


def chunks(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """Rows of documents (key is null) and of the chunks' dictionaries. The tokenizers' files (about 2 MB, a fixed size) are read
    on the driver and broadcast."""
    with open(vocabulary, encoding="utf-8") as f, open(model, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*sent.value)
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk(both)

        def batch_of(size: int, **given) -> pa.RecordBatch:
            cols = [given[name] if name in given else pa.nulls(size, kind or id_type) for name, kind, _ in _COLUMNS]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind or id_type) for c, (_, kind, _) in zip(cols, _COLUMNS, strict=True)], names=[c[0] for c in _COLUMNS])

        def dictionary() -> Iterator[pa.RecordBatch]:
            rows = list(chunk.dictionary())
            for at in range(0, len(rows), 1 << 14):
                part = list(zip(*rows[at : at + (1 << 14)], strict=True))
                yield batch_of(len(part[0]), chunk=[number] * len(part[0]), number=part[0], key=part[1], docs=part[2])

        for batch in slices(batches, "alignment"):
            ids, texts = batch.column(0), batch.column(1)
            id_type, at = ids.type, 0
            while at < batch.num_rows:
                taken, chars = [], 0
                while at + len(taken) < batch.num_rows and chars < TOGETHER:
                    taken.append(texts[at + len(taken)].as_py())
                    chars += len(taken[-1] or "")
                cols = list(zip(*chunk.add(taken), strict=True))
                yield batch_of(len(taken), chunk=[number] * len(taken), doc_id=ids.slice(at, len(taken)), n_a=cols[0], n_b=cols[1], n_groups=cols[2], n_links=cols[3], groups_sha256=cols[4], numbers=cols[5], times=cols[6])
                at += len(taken)
                if chunk.full():
                    yield from dictionary()
                    number, chunk = number + 1, Chunk(both)
        if chunk.documents:
            yield from dictionary()

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{name} {ddl or id_type}" for name, _, ddl in _COLUMNS))


def links(groups: DataFrame) -> DataFrame:
    """Each distinct group once: (key, a, b, times, docs) for its distinct id pairs; times: how many links they have there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[tuple]) -> pa.RecordBatch:
            key, a, b, times, docs = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(times, pa.int64()), pa.array(docs, pa.int64())], names=["key", "a", "b", "times", "docs"])

        rows: list[tuple] = []
        for batch in slices(batches, "alignment"):
            for key, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (Counter(map(int, half.split(","))) for half in key.split("|"))
                for x, m in a.items():
                    for y, n in b.items():
                        rows.append((key, x, y, m * n, docs))
                    if len(rows) >= 1 << 14:
                        yield sent(rows)
                        rows = []
        if rows:
            yield sent(rows)

    return groups.select("key", "docs").mapInArrow(run, "key string, a int, b int, times long, docs long")


def group_values(groups: DataFrame) -> DataFrame:
    """groups(key, docs) -> (key, total, best): the sum of the counts of a group's links, and how many are best for their A id."""
    expanded = store(links(groups))
    pairs = expanded.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    # One row for each A id: never more than the vocabulary has.
    most = F.broadcast(pairs.groupBy("a").agg(F.max("docs").alias("most")))
    counts = pairs.join(most, "a").select("a", "b", F.col("docs").alias("count"), (F.col("docs") == F.col("most")).alias("is_best"))
    each = expanded.drop("docs").join(counts, ["a", "b"])
    return each.groupBy("key").agg(F.sum(F.col("times") * F.col("count")).alias("total"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("best"))


_RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _to_documents(key: tuple, docs: pa.Table, values: pa.Table) -> pa.Table:
    """The values of a chunk's groups, summed by the frequencies of its documents."""
    number = values.column("number").to_numpy()
    most = int(number.max(initial=-1)) + 1
    sums = []
    numbers, times = (docs.column(c).combine_chunks() for c in ("numbers", "times"))
    at, flat, often = numbers.offsets.to_numpy(), numbers.values.to_numpy(), times.values.to_numpy().astype(np.int64)
    for name in ("best", "total"):
        of_number = np.zeros(most, np.int64)
        of_number[number] = values.column(name).to_numpy()
        running = np.concatenate(([0], np.cumsum(of_number[flat] * often)))
        sums.append(pa.array(running[at[1:]] - running[at[:-1]], pa.int64()))
    out = docs.append_column("n_best", sums[0]).append_column("count_sum", sums[1])
    return out.select(list(_RESULT))


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> the counts of each document's groups and links, see the module."""
    with temporary_stores(docs.sparkSession):
        made = store(chunks(docs, vocabulary or default_vocabulary(), model or default_model()))
        values = group_values(made.where("key IS NOT NULL").groupBy("key").agg(F.sum("docs").alias("docs")))
        back = made.where("number IS NOT NULL").select(F.col("chunk").alias("of_chunk"), "number", "key").join(values, "key").select("of_chunk", "number", "total", "best")
        own = made.where("key IS NULL").select("chunk", *(c for c in _RESULT if c not in ("n_best", "count_sum")), "numbers", "times")
        id_type = dict(docs.dtypes)["doc_id"]
        ddl = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        return materialize(own.groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(_to_documents, ddl))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read_table(spark, sf_dir, "documents", "doc_id", "text"))
