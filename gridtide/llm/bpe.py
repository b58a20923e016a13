"""Byte-pair encoding and decoding with a published vocabulary.

Method: forced-boundary splitting.  A pair of neighbouring bytes that occurs
inside no vocabulary token can never be inside an output token, so there is a
certain cut between the two.  Every piece of the pre-tokenizer is cut there,
the fragments are merged independently, and their ids are put together.

The vocabulary is a byte-level BPE file in the JSON form of the ``tokenizers``
library; its path must be readable on every executor.  Encoding gives what that
library gives with ``add_special_tokens=False`` and without truncation and
padding: added tokens of the file are found in the text, merges follow their
rank, and equal ranks go from left to right.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridtide.llm.words import forget_others, text_chunks

#: Fixed value: the splitting pattern of byte-level pre-tokenizers, with
#: ``\s`` written out as Unicode's White_Space property.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pieces remembered by a worker; beyond that it starts afresh.
CACHED_PIECES = 1 << 18
#: Longer pieces are rare and are not remembered.
CACHED_CHARS = 48
#: Fragments of more bytes are merged from a heap.
LONG_FRAGMENT = 64
#: Rows decoded at once.
DECODED_ROWS = 64
_NONE = 1 << 62
_ID = (1 << 32) - 1


def _printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes take
    the code points from 256 on, in ascending order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def finder() -> re.Pattern[str]:
    """``PIECES`` for texts without characters beyond U+FFFF, as a pattern of ``re``, which is faster than ``regex``.

    The classes are those of ``regex``, written out; letters, which are most pieces, are tried first.
    """
    text = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)

    def written(kind: str) -> str:
        runs = ((m.start(), m.end()) for m in regex.finditer(rf"\p{{{kind}}}+", text))
        return "".join(f"\\u{ord(text[a]):04x}-\\u{ord(text[b - 1]):04x}" for a, b in runs)

    letter, number, space = map(written, ("L", "N", "White_Space"))
    return re.compile(f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_BEYOND = re.compile("[\U00010000-\U0010ffff]").search


class _FirstMerges(dict):
    """Merges of two bytes; a pair without one has the greatest rank."""

    def __missing__(self, pair: tuple[int, int]) -> int:
        return _NONE


def _token_bytes(spec: dict) -> tuple[dict[bytes, int], dict[str, int], list[bytes]]:
    """Ids by token, ids of added tokens, and each id's bytes."""
    to_byte = _printable_bytes()
    vocab = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    bytes_of = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for token, i in vocab.items():
        bytes_of[i] = token
    for token, i in added.items():
        bytes_of[i] = token.encode()
    return vocab, added, bytes_of


class Vocabulary:
    """A byte-level BPE vocabulary with its certain cuts."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = _printable_bytes()
        raw = lambda token: bytes(to_byte[c] for c in token)
        vocab, self.added, self.bytes_of = _token_bytes(spec)
        self.numbers = list(range(len(self.bytes_of)))
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        #: (id, id) of a mergeable pair as one number: its rank and the id it becomes, as one number too.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            self.merges.setdefault(vocab[left] << 32 | vocab[right], rank << 32 | vocab[left + right])
        byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        ends = ((p, byte_of.get(p >> 32), byte_of.get(p & _ID)) for p in self.merges)
        self.first = _FirstMerges({(a, b): self.merges[p] for p, a, b in ends if a is not None and b is not None})
        #: Pairs of neighbouring bytes that some token holds inside.
        self.joined = {pair for token in vocab for pair in itertools.pairwise(token)}
        self.find_any, self.find_near = regex.compile(PIECES).findall, finder().findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.cache = _Pieces(self)

    def fragments(self, piece: bytes) -> list[bytes]:
        """``piece`` cut at every byte pair that is inside no token."""
        joined = self.joined
        if joined.issuperset(itertools.pairwise(piece)):
            return [piece] if piece else []
        cuts = [i for i, pair in enumerate(itertools.pairwise(piece), 1) if pair not in joined]
        return [piece[a:b] for a, b in itertools.pairwise([0, *cuts, len(piece)])]

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of a fragment: the pair of least rank first, from left to right."""
        ids = [self.byte_ids[b] for b in fragment]
        find = self.merges.get
        if len(ids) > LONG_FRAGMENT:
            return self._merge_long(ids)
        ranks = list(map(self.first.__getitem__, itertools.pairwise(fragment)))
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            ids[i : i + 2] = [best & _ID]
            del ranks[i]
            if i:
                ranks[i - 1] = find(ids[i - 1] << 32 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = find(ids[i] << 32 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same from a heap of pairs, in n log n: a pair that is gone by its turn is passed over."""
        find, n = self.merges.get, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, i) for i, (a, b) in enumerate(itertools.pairwise(ids)) if (m := find(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            merge, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or find(ids[i] << 32 | ids[j]) != merge:
                continue
            ids[i], ids[j] = merge & _ID, -1
            k, left = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (m := find(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (m, i))
            if left >= 0 and (m := find(ids[left] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (m, left))
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        found = (self.merge(f) for f in self.fragments(piece.encode()))
        # Numbers that all pieces share: those remembered take less memory.
        return tuple(map(self.numbers.__getitem__, itertools.chain.from_iterable(found)))

    def find(self, text: str) -> list[str]:
        """The pieces of a text."""
        return self.find_near(text) if text.isascii() or not _BEYOND(text) else self.find_any(text)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        for k, part in enumerate(self.split(text) if self.added else [text]):
            if k % 2:
                ids.append(self.added[part])
            elif part:
                ids.extend(itertools.chain.from_iterable(map(self.cache.__getitem__, self.find(part))))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Pieces(dict):
    """Ids by piece, for the pieces met lately."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.vocabulary.encode_piece(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One copy for each worker process."""
    return Vocabulary(path)


@functools.cache
def token_bytes(path: str) -> pa.Array:
    """Each id's bytes: all that decoding needs of a vocabulary."""
    with open(path, encoding="utf-8") as file:
        return pa.array(_token_bytes(json.load(file))[2], pa.large_binary())


def decoded(ids: pa.Array, tokens: pa.Array) -> list[str]:
    """The texts of some arrays of ids."""
    flat, counts = ids.flatten(), pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        raise ValueError("an id is null")
    taken = tokens.take(flat)
    if not len(taken):
        return [""] * len(ids)
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[np.concatenate(([0], np.cumsum(counts)))].tolist()
    raw = data.to_pybytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(ends)]


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name != name]
    return T.StructType([*kept, T.StructField(name, kind)])


def encode_texts(df: DataFrame, path: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids``, the token ids of ``column`` as an array.

    A null or empty text has no ids (an empty array).  Whole texts are encoded,
    however long.  A column already called ``ids`` is replaced; all others,
    repeated rows included, stay as they are.
    """
    schema = _with_column(df, ids, T.ArrayType(T.IntegerType(), False))
    place = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("bpe")
        encode = vocabulary(path).encode
        for batch in batches:
            for a, b in text_chunks(batch[column]):
                part = batch.slice(a, b - a)
                found = [encode(t) for t in part[column].fill_null("").to_pylist()]
                offsets = np.zeros(len(found) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                flat = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=offsets[-1])
                yield pa.RecordBatch.from_arrays([*(part[n] for n in place), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*place, ids])

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``df`` with ``column``, the text that the array ``ids`` stands for.

    Added tokens are spelled out.  A null array gives the empty text; bytes that
    are no UTF-8 become replacement characters.  An id outside the vocabulary
    fails the job.  A column already called like ``column`` is replaced.
    """
    schema = _with_column(df, column, T.StringType())
    place = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("bpe")
        tokens = token_bytes(path)
        for batch in batches:
            for a in range(0, len(batch), DECODED_ROWS):
                part = batch.slice(a, DECODED_ROWS)
                texts = pa.array(decoded(part[ids], tokens), pa.string())
                yield pa.RecordBatch.from_arrays([*(part[n] for n in place), texts], names=[*place, column])

    return df.mapInArrow(run, schema)
