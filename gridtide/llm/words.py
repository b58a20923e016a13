"""Words of many texts at once, as numpy arrays over one UTF-8 buffer.

Texts arrive as Arrow string arrays.  A chunk of them is one byte buffer with
offsets; words are runs of bytes of a class, and no word crosses a text's edge.
Both word classes used here end at ASCII bytes only, so working on bytes gives
the same words as working on code points.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

# Freed batches go back to the system: the workers of an executor share its memory.
pa.set_memory_pool(pa.system_memory_pool())

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Words that end at space and at the control characters 9 to 13.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[ord("0") : ord("9") + 1] = True
ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[128:] = True


def give_back() -> None:
    """Return what this process has freed to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def forget_others(own: str = "") -> None:
    """Drop what the encoders of other operators remember in this worker, which a pipeline uses again."""
    for module, name in (("bpe", "vocabulary"), ("packing", "encoder")):
        found = sys.modules.get(f"gridtide.llm.{module}")
        if found is not None and module != own and getattr(found, name).cache_info().currsize:
            getattr(found, name).cache_clear()
            gc.collect()
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to ``n`` of them."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1))
        for i, base in enumerate((_BASE, _UNBASE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers[0][:n], _powers[1][:n]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; every row is in exactly one."""
    n = len(column)
    sizes = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
    begin, held = 0, 0
    for i in range(n):
        if held and held + sizes[i] > limit:
            yield begin, i
            begin, held = i, 0
        held += int(sizes[i])
    if begin < n:
        yield begin, n


class Words:
    """The words of a slice of texts, lower-cased in A-Z; null counts as empty."""

    def __init__(self, column: pa.Array, kind: np.ndarray) -> None:
        column = column.cast(pa.large_string()).fill_null("")
        raw = column.buffers()
        offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(raw[2], dtype=np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        self.bytes = _LOWER[data]
        self.offsets = offsets - low
        inside = kind[self.bytes]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, equal for equal words wherever they stand."""
        up, down = _power_tables(len(self.bytes) + 1)
        sums = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.bytes] * up[: len(self.bytes)], out=sums[1:])
        own = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(own + (self.ends - self.starts).astype(np.uint64) * _BASE)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` neighbouring words (over text edges too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(k * int(_BASE) & (1 << 64) - 1), dtype=np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * _BASE
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(words: Words, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted per text: (text index, hash).

    A text of fewer than ``k`` words, but not none, has its whole word sequence
    as its one shingle.
    """
    hashes = words.hashes() if hashes is None else hashes
    grams = gram_hashes(hashes, k)
    ok = words.text[: len(grams)] == words.text[k - 1 :] if len(grams) else np.zeros(0, bool)
    text, value = words.text[: len(grams)][ok], grams[ok]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = [gram_hashes(hashes[words.first[i] : words.first[i + 1]], int(words.counts[i]))[0] for i in short]
        text = np.concatenate((text, short))
        value = np.concatenate((value, np.array(whole, dtype=np.uint64)))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    if len(text):
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])))
        text, value = text[new], value[new]
    return text, value
