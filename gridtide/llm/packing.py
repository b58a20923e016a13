"""Packing of documents into token sequences of one fixed length.

Method: large-item matching, then best fit.  Pieces above one third of the
capacity can meet at most in twos, so they are matched greedily: the largest
takes the largest that still fits beside it.  The smaller pieces follow from
large to small, each into the sequence whose gap is the smallest that holds it,
or into a new one.

All pieces of one length are alike to this method, so it runs on the number of
pieces of each length: at most ``capacity`` numbers, whatever the table holds.
Its result is a plan of ranges (the pieces number r to s of length x go to the
sequences from b on, at this offset).  A sequence holds pieces of at most about
``sqrt(2 * capacity)`` different lengths, which bounds the plan as well.  Every
piece gets its number among those of its length from a count in its own task and
the counts of the tasks before, and looks its place up in the plan.
"""

from __future__ import annotations

import functools
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.words import text_chunks
from gridtide.session import scratch_folder

#: Words and word parts remembered by a worker; beyond that it starts afresh.
CACHED = 1 << 19
#: Longer ones are rare and are not remembered.
CACHED_LENGTH = 64
#: Characters whose case, class and normal form are the same in every version of Unicode, and no white space.
PLAIN = r"[\x21-\x7e\xa1-įı-ɏ]+"
#: Fixed value: the splitting pattern of the vocabulary's pre-tokenizer.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Fixed value: how the names of added tokens begin.
ADDED = "<|"
#: Signs that often end a word.
SIGNS = b".,;:!?"


def _byte_letters() -> dict[int, int]:
    """The character that byte-level vocabularies have for each byte beyond printable ones, by code point."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts, word by word, with a file of the ``tokenizers`` library.

    The vocabulary drops white space, and no token reaches over it, so a text's
    ids are those of its words in turn.  The library encodes each word once as
    long as it is remembered.  For words of plain characters only its merging is
    asked, once for each part that its pre-tokenizer would cut out; all other
    words go through the whole library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.merge = self.whole.model.tokenize
        self.plain = regex.compile(PLAIN).fullmatch
        self.find = regex.compile(PARTS).findall
        self.letters = _byte_letters()
        self.words = _Remembered(self.word)
        self.parts = _Remembered(self.part)

    def part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.merge(spelled)])

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        # Letters alone, or with one sign behind them, need no pattern.
        if word.isalpha():
            return self.parts[text.lower()]
        if word[:-1].isalpha() and word[-1] in SIGNS:
            return self.parts[text[:-1].lower()] + self.parts[text[-1]]
        if ADDED not in text and self.plain(text):
            return b"".join(map(self.parts.__getitem__, self.find(text.lower())))
        return _packed(self.whole.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> np.ndarray:
        if ADDED.encode() not in text:
            text = text.lower()  # of A-Z alone, which the library does to all words
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), dtype="<u4")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Remembered(dict):
    """What ``make`` gives for a key, for the keys met lately."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: bytes | str) -> bytes:
        found = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[key] = found
        return found


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def cut_texts(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, column: str = "text", keep_ids: bool = True) -> DataFrame:
    """Token pieces of ``column``: the other columns with ``piece, start, length, ids_crc32`` and ``ids``.

    A text is its ids and ``end_id``; a null or empty one is ``end_id`` alone.
    One with more than ``capacity`` ids is cut into pieces of that many, the last
    of which may be shorter.  ``start`` counts the ids before the piece, and
    ``ids_crc32`` is the checksum of its ids as little-endian 32-bit numbers.
    Whole texts are encoded, however long; repeated rows are cut each for itself;
    an empty table has no pieces.  ``column`` does not remain, and columns called
    like the new ones are replaced.  The vocabulary must drop white space.
    """
    new = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if keep_ids else []
    taken = {column, *(f.name for f in new)}
    kept = [f for f in df.schema.fields if f.name not in taken]
    schema = T.StructType([*kept, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
            for a, b in text_chunks(batch.column(column)):
                ids = [np.concatenate((encode(t), end)) for t in texts.slice(a, b - a).to_pylist()]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(a, b), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                cut = [x[k : k + capacity] for x in ids for k in range(0, len(x), capacity)]
                sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in cut]
                lengths = np.array([len(x) for x in cut], dtype=np.int64)
                columns = [batch.column(f.name).take(pa.array(row)) for f in kept]
                columns += [pa.array(number.astype(np.int32)), pa.array(number * capacity), pa.array(lengths), pa.array(sums, pa.int64())]
                if keep_ids:
                    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cut).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


class Plan:
    """Where the pieces of each length go, by their number among those of that length."""

    def __init__(self) -> None:
        #: length, first number, first sequence, pieces of this range in one sequence, offset of the first of them
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self._given: dict[int, int] = defaultdict(int)

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, sequence: int, sequences: int, each: int, offset: int) -> None:
        self.rows.append((length, self._given[length], sequence, each, offset))
        self._given[length] += sequences * each

    def table(self) -> tuple[np.ndarray, ...]:
        """The rows as columns, sorted by length and first number."""
        return tuple(np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 5).T)


def plan_sequences(counts: Mapping[int, int], capacity: int) -> Plan:
    """A plan for ``counts`` pieces of each length from 1 to ``capacity``.

    Ties do not arise: pieces of one length are alike, and so are sequences
    with gaps of one size, of which the one opened last is taken first.
    """
    plan, left = Plan(), {x: n for x, n in counts.items() if n > 0}
    gaps: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}

    def leave(gap: int, sequence: int, n: int) -> None:
        """``n`` sequences with this gap, from ``sequence`` on."""
        if gap and n:
            if gap not in ranges:
                insort(gaps, gap)
                ranges[gap] = []
            ranges[gap].append((sequence, n))

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        x = large[-1]
        if x <= capacity - x and left[x] > 1:
            n = left[x] // 2
            first = plan.open(n)
            plan.put(x, first, n, 2, 0)
            leave(capacity - 2 * x, first, n)
            left[x] -= 2 * n
        if left[x]:
            below = bisect_left(large, min(x, capacity - x + 1))
            y = large[below - 1] if below else None
            n = min(left[x], left[y]) if y else left[x]
            first = plan.open(n)
            plan.put(x, first, n, 1, 0)
            left[x] -= n
            if y:
                plan.put(y, first, n, 1, x)
                left[y] -= n
                if not left[y]:
                    large.pop(below - 1)
            leave(capacity - x - (y or 0), first, n)
        if not left[x]:
            large.pop()

    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[x]
        while n:
            at = bisect_left(gaps, x)
            if at == len(gaps):
                sequences = -(-n // (capacity // x))
                gap, first = capacity, plan.open(sequences)
            else:
                gap = gaps[at]
                first, sequences = ranges[gap].pop()
                if not ranges[gap]:
                    del ranges[gap]
                    gaps.pop(at)
            each = gap // x
            full = min(sequences, n // each)
            if full:
                plan.put(x, first, full, each, capacity - gap)
                leave(gap - each * x, first, full)
                n -= full * each
            if full < sequences:
                # No full share is left: one sequence takes the rest, the others wait.
                if n:
                    plan.put(x, first + full, 1, n, capacity - gap)
                    leave(gap - n * x, first + full, 1)
                    full, n = full + 1, 0
                leave(gap, first + full, sequences - full)
    return plan


#: More pieces of one length than any table has.
_NUMBERS = 1 << 44


def _number_in_task(df: DataFrame, length: str, capacity: int) -> DataFrame:
    """``df`` with ``part`` (its task) and ``local`` (its number among the task's pieces of that length)."""
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            x = batch.column(length).fill_null(0).to_numpy(zero_copy_only=False)
            order = np.argsort(x, kind="stable")
            counts = np.bincount(x, minlength=capacity + 1)
            local = np.empty(len(x), dtype=np.int64)
            local[order] = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
            local += seen[x]
            seen += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), part, np.int32)), pa.array(local)], names=schema.names)

    return df.mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, packed into few sequences of ``capacity`` tokens.

    Offsets in a sequence are gapless from 0.  A piece whose ``length`` is null,
    below 1 or above ``capacity`` is in no sequence: both columns are null.
    Repeated rows and pieces of equal length are packed each for itself; which of
    them goes where depends on their order in the table only.  An empty table
    gives an empty one.  Columns called like the new ones are replaced.

    Runs when it is called: the pieces are stored in the shared scratch folder,
    with their numbers.  Pass narrow rows; they are shuffled once.  Pieces of one
    length may be any share of the table.
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    fits = F.col(length).between(1, capacity)
    narrow = pieces.select(F.struct(*kept).alias("own"), F.when(fits, F.col(length).cast("int")).alias("size"))
    folder = scratch_folder(spark, "pieces")
    _number_in_task(narrow, "size", capacity).write.parquet(folder)
    rows = spark.read.parquet(folder)

    parts = rows.filter("size IS NOT NULL").groupBy("size", "part").agg(F.count("*").alias("n"))
    counts = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    table = plan_sequences(counts, capacity).table()
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.join(starts, ["size", "part"], "left").select("own", "size", (F.col("before") + F.col("local")).alias("number"))
    schema = T.StructType([numbered.schema["own"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, first, sequence, each, offset = table
        keys = sizes * _NUMBERS + first
        for batch in batches:
            missing = batch.column("size").is_null().to_numpy(zero_copy_only=False)
            size, number = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "number"))
            if len(keys):
                at = np.searchsorted(keys, size * _NUMBERS + number, "right") - 1
                up, inside = np.divmod(number - first[at], each[at])
                out = [sequence[at] + up, offset[at] + inside * size]
            else:
                out = [number, number]
            yield pa.RecordBatch.from_arrays([batch.column("own"), *(pa.array(x, pa.int64(), mask=missing) for x in out)], names=schema.names)

    placed = numbered.mapInArrow(place, schema)
    return placed.select("own.*", "sequence_id", "offset")


def packed_sequences(packed: DataFrame, *carried: str | Column) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``ids`` and ``pieces`` (offset, length and the carried columns).

    ``packed`` is the result of :func:`pack_pieces` over pieces with ``ids``.  A
    sequence is at most as long as the capacity, and so is what a task gathers
    for one.
    """
    piece = F.struct("offset", "length", *carried)
    listed = packed.filter("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct(F.col("offset").alias("at"), piece.alias("piece"), "ids"))).alias("all"))
    return listed.select("sequence_id", F.flatten("all.ids").alias("ids"), F.col("all.piece").alias("pieces"))
