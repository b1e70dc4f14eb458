"""Operator 1, byte-level BPE encoding and decoding by dynamic programming over prefixes.

A byte pair encoding of a prefix has one last token only. For every prefix, longest first, the tokens that
are a suffix of it come from an automaton of the vocabulary's prefixes with links between suffixes (one step per
byte; along the links lie the tokens that end there). Such a token is the last one if it starts the word or if the last token of the
prefix before it and the token itself stay two tokens when their bytes are merged by rank. That pair test
undoes merges on both sides of the border and looks for a merge across it that would have come first.
Back-pointers from the whole word give the ids. Words (the pre-tokenizer's pieces) are remembered until
the task ends, up to a bound on their number, as the same bytes have the same ids.

Cases: a null text is empty; it has no tokens and decodes to the empty text. Texts of any length are
encoded whole; a piece of any length takes time in proportion to it. Rows stand for themselves, so repeated
rows and ties need no rule; an empty table gives an empty one. Other columns pass through, those named like the
new ones are replaced. Vocabularies in which two merges make one token, or added tokens look at their
surroundings, are an error.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import KEPT, give_back, read_table, slices

#: The pre-tokenizer's pattern, a fixed value of byte-level vocabularies; white space is Unicode's property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words remembered in a task (three times as many at most, twice as many pairs and steps), and the longest of them in
#: characters.
REMEMBERED, LONGEST = 1 << 17, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(spare)): b for b in range(256)}


class Codec:
    """Encoder and decoder of one vocabulary. Ids of merged tokens rise with the rank of their merge."""

    def __init__(self, vocabulary: dict):
        of_char = byte_characters()
        model = vocabulary["model"]
        self.token = {i: bytes(of_char[c] for c in text) for text, i in model["vocab"].items() if all(c in of_char for c in text)}
        added = vocabulary.get("added_tokens", ())
        if any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their surroundings aren't supported")
        self.special = {x["content"]: x["id"] for x in added}
        self.token |= {i: text.encode() for text, i in self.special.items()}
        ids = {text: i for i, text in self.token.items() if i not in self.special.values()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = (ids[bytes(of_char[c] for c in x)] for x in (a, b))
            whole = ids[self.token[left] + self.token[right]]
            if whole in self.rank:
                raise ValueError(f"two merges make token {whole}; last tokens of prefixes aren't unique then")
            self.rank[whole] = rank
            self.merged[left << 32 | right] = whole
            self.halves[whole] = left, right
        self._automaton(ids)
        #: Pair tests, steps with their suffix links and suffixes of states, as they turn up.
        self.pairs: dict[int, bool] = {}
        self.steps: dict[int, int] = {}
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.own)
        #: Words seen twice of late, those of some time before, and words seen once.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _automaton(self, ids: dict[bytes, int]) -> None:
        """States are prefixes of tokens, numbered layer by layer of nothing but numbers: child by state and byte,
        link to the longest proper suffix that is a state, own token (-1 for none), the state's depth, and the next
        state along the links that has a token."""
        self.child: dict[int, int] = {}
        parent, byte = array("i", [0]), bytearray(1)
        self.own, self.depth = array("i", [-1]), array("i", [0])
        for text, i in ids.items():
            at = 0
            for n, b in enumerate(text, 1):
                nxt = self.child.get(at << 8 | b)
                if nxt is None:
                    nxt = self.child[at << 8 | b] = len(self.own)
                    parent.append(at)
                    byte.append(b)
                    self.own.append(-1)
                    self.depth.append(n)
                at = nxt
            self.own[at] = i
        self.link, self.more = array("i", [0]) * len(self.own), array("i", [0]) * len(self.own)
        for state in sorted(range(1, len(self.own)), key=self.depth.__getitem__):
            up, b = parent[state], byte[state]
            if up:
                up = self.link[up]
                while up and up << 8 | b not in self.child:
                    up = self.link[up]
                up = self.child.get(up << 8 | b, 0)
            self.link[state] = up
            self.more[state] = up if self.own[up] >= 0 else self.more[up]
        self.own, self.depth, self.link, self.more = (x.tolist() for x in (self.own, self.depth, self.link, self.more))

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves left and right as two tokens when their bytes stand side by side."""
        rank, halves, merged = self.rank, self.halves, self.merged
        bound = len(rank) + 1
        while True:
            across = merged.get(left << 32 | right)
            if across is not None and rank[across] < bound:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # The later of the two merges is undone: the higher rank, among equals the right one. A merge
            # across wins if it comes before the undone one; at the same rank the leftmost comes first.
            if a > b:
                bound, left = a, halves[left][1]
            else:
                bound, right = b + 1, halves[right][0]

    def _step(self, key: int) -> int:
        """The state after another byte, along suffix links where need be; key is state and byte."""
        at, b = key >> 8, key & 0xFF
        while at and at << 8 | b not in self.child:
            at = self.link[at]
        if len(self.steps) >= 2 * REMEMBERED:
            self.steps.clear()
        self.steps[key] = found = self.child.get(at << 8 | b, 0)
        return found

    def _ends(self, state: int) -> tuple[tuple[int, int], ...]:
        """Tokens that are suffixes of the state, longest first, with their lengths."""
        out = []
        at = state if self.own[state] >= 0 else self.more[state]
        while at:
            out.append((self.own[at], self.depth[at]))
            at = self.more[at]
        self.ends[state] = tuple(out)
        return self.ends[state]

    def encode_word(self, data: bytes) -> list[int]:
        last = [0] * (len(data) + 1)
        size = [0] * (len(data) + 1)
        step, ends, pair = self.steps.get, self.ends, self.pairs.get
        state = 0
        for end, b in enumerate(data, 1):
            key = state << 8 | b
            state = step(key)
            if state is None:
                state = self._step(key)
            for token, length in ends[state] or self._ends(state):
                start = end - length
                if start:
                    key = last[start] << 32 | token
                    ok = pair(key)
                    if ok is None:
                        if len(self.pairs) >= 2 * REMEMBERED:
                            self.pairs.clear()
                        ok = self.pairs[key] = self.stays_apart(last[start], token)
                    if not ok:
                        continue
                last[end], size[end] = token, length
                break
            else:
                raise ValueError("the vocabulary lacks a byte")
        out = []
        end = len(data)
        while end:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def _packed(self, word: str) -> bytes:
        """The ids of a word that isn't among the words at hand. Words stay there from their second time on."""
        packed = self.older.get(word) or self.once.pop(word, None)
        if packed is None:
            packed = array("I", self.encode_word(word.encode())).tobytes()
            if len(word) <= LONGEST:
                if len(self.once) >= REMEMBERED:
                    self.once.clear()
                self.once[word] = packed
        else:
            if len(self.words) >= REMEMBERED:
                self.words, self.older = {}, self.words
            self.words[word] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            out += [self.words.get(word) or self._packed(word) for word in self.pieces.findall(part)]
        return b"".join(out)

    def forget_words(self) -> None:
        """A worker waits between tasks, and there are more workers than cores: what waits holds the vocabulary alone."""
        self.words, self.older, self.once = {}, {}, {}

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec(vocabulary_text: str) -> Codec:
    return Codec(json.loads(vocabulary_text))


KEPT["bpe"] = codec.cache_clear


def _rows(own: Codec, batches: Iterator[pa.RecordBatch], kept: list[str], schema: pa.Schema, row, text: str) -> Iterator[pa.RecordBatch]:
    """The batches with their new columns; words are remembered until the task ends."""
    try:
        for batch in slices(batches, "bpe"):
            rows = [row(own, t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], names=kept + schema.names
            )
    finally:
        own.forget_words()
        give_back()


def _mapped(docs: DataFrame, vocabulary: str, schema: pa.Schema, ddl: str, row, text: str) -> DataFrame:
    """Rows of docs through row(codec, text) -> tuple of the new columns, batch by batch. The vocabulary file
    (1.5 MB, a fixed size) is read on the driver and goes out as a broadcast."""
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c not in schema.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(codec(sent.value), batches, kept, schema, row, text)

    types = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), ddl]))


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs with token_ids array<int>."""
    schema = pa.schema([("token_ids", pa.list_(pa.int32()))])
    return _mapped(docs, vocabulary or default_vocabulary(), schema, "token_ids array<int>", lambda c, t: (np.frombuffer(c.encode_packed(t), "<i4"),), text)


def roundtrip_digests(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs with n_tokens and the digests of the ids and of the text decoded from them."""

    def row(own: Codec, t: str) -> tuple:
        packed = own.encode_packed(t)
        decoded = own.decode(np.frombuffer(packed, "<u4").tolist())
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _mapped(docs, vocabulary or default_vocabulary(), schema, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, text)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip_digests(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline's last stage: the documents with their token ids."""
    return encode(docs)
