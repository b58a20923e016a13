"""Periodic runs of words: stretches that repeat one block again and again.

Method: longest common extensions in suffix trees.  Of a stretch of words and of
its reversal Ukkonen's construction gives the suffix trees; a tour of each tree
with a sparse table over it gives the lowest common ancestor of two leaves, and
with it the longest common extension of two places, in constant time.  Every run
has a Lyndon root: for one of the two orders of words it begins at some place
with the longest Lyndon word that starts there.  These words, found from the
order of the leaves, are the candidates; each is extended in both directions.

Before that, words that cannot be in a run of four periods are cut away: such a
run holds each of its words at least four times, so one that is rarer in its
stretch is in none, and what it separates are stretches of their own.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridtide.llm.words import text_chunks

#: A run has at least this many periods and this many words.
PERIODS, WORDS = 4, 6


class SuffixTree:
    """The suffix tree of a sequence of numbers from 1 on, closed by a 0 of its own."""

    def __init__(self, symbols: list[int]) -> None:
        s = [*symbols, 0]
        n, sigma = len(s), max(s) + 1
        kids: dict[int, int] = {}  # node * sigma + first symbol -> node
        start, stop, link, depth, suffix = [0], [0], [0], [0], [-1]
        node = edge = length = pending = leaves = 0
        for i, c in enumerate(s):
            unlinked = 0
            pending += 1
            while pending:
                if not length:
                    edge = i
                key = node * sigma + s[edge]
                child = kids.get(key)
                if child is None:
                    kids[key] = len(start)
                    tail = node
                else:
                    whole = stop[child] - start[child]
                    if length >= whole:
                        node, edge, length = child, edge + whole, length - whole
                        continue
                    if s[start[child] + length] == c:
                        if unlinked:
                            link[unlinked] = node
                        length += 1
                        break
                    tail = len(start)
                    kids[key] = tail
                    start.append(start[child])
                    stop.append(start[child] + length)
                    link.append(0)
                    depth.append(depth[node] + length)
                    suffix.append(-1)
                    start[child] += length
                    kids[tail * sigma + s[start[child]]] = child
                    kids[tail * sigma + c] = len(start)
                if unlinked:
                    link[unlinked] = tail
                unlinked = tail if child is not None else 0
                start.append(i)
                stop.append(n)
                link.append(0)
                depth.append(n - leaves)
                suffix.append(leaves)
                leaves += 1
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self._tour(kids, sigma, np.array(depth, np.int32), np.array(suffix, np.int64))

    def _tour(self, kids: dict[int, int], sigma: int, depth: np.ndarray, suffix: np.ndarray) -> None:
        """Walk the tree in order of symbols and prepare ancestors in constant time.

        A node is noted where the walk enters it, with its parent's depth.  The
        lowest common ancestor of two leaves is the shallowest parent noted
        between them.
        """
        keys = np.fromiter(kids.keys(), np.int64, len(kids))
        child = np.fromiter(kids.values(), np.int64, len(kids))
        order = np.argsort(-keys)  # a node's children together, the greatest symbol first
        keys, child = keys[order] // sigma, child[order]
        nodes = len(depth)
        first = np.searchsorted(-keys, -np.arange(nodes), "left").tolist()
        last = np.searchsorted(-keys, -np.arange(nodes), "right").tolist()
        below, walk, stack = child.tolist(), [], [0]
        while stack:
            v = stack.pop()
            walk.append(v)
            stack += below[first[v] : last[v]]
        parent = np.zeros(nodes, np.int64)
        parent[child] = keys
        visited = np.array(walk)
        entered = np.empty(nodes, np.int64)
        entered[visited] = np.arange(nodes)
        leaf = suffix[visited]
        #: Starts of the suffixes in ascending order, the closing 0 first.
        self.suffixes = leaf[leaf >= 0]
        self.place = np.empty(len(self.suffixes), np.int64)
        self.place[self.suffixes] = entered[visited[leaf >= 0]]
        rows = [depth[parent[visited]]]
        for k in range(max(nodes - 1, 1).bit_length() - 1):
            rows.append(np.minimum(rows[-1][: -(1 << k)], rows[-1][1 << k :]))
        self.least = rows

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes from ``a`` and from ``b`` (different places) have in common."""
        x, y = self.place[a], self.place[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            row, at = self.least[k], np.flatnonzero(level == k)
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def _next_less(rank: list[int]) -> np.ndarray:
    """For each place the next one with a lesser rank, or the end."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def runs_of(symbols: np.ndarray) -> np.ndarray:
    """All runs of a sequence of numbers from 1 on: distinct rows of start, length, period."""
    n = len(symbols)
    tree = SuffixTree(symbols.tolist())
    rank = np.empty(n + 1, np.int64)
    rank[tree.suffixes] = np.arange(n + 1)
    found = []
    for order in (rank, -rank):
        # The longest Lyndon word from a place on ends before the next lesser suffix.
        period = (_next_less(order.tolist()) - np.arange(n + 1))[:n]
        at = np.flatnonzero((period * PERIODS <= n) & (np.arange(n) + period < n))
        found.append(np.stack((at, period[at])))
    at, period = np.concatenate(found, axis=1)
    ahead = tree.common(at, at + period)
    del tree
    behind = SuffixTree(symbols[::-1].tolist()).common(n - at, n - at - period)
    start, length = at - behind, ahead + behind + period
    kept = (length >= PERIODS * period) & (length >= WORDS)
    return np.unique(np.stack((start, length, period), axis=1)[kept], axis=0)


def _stretches(symbols: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches outside which there is no run: each word in one is in it at least ``PERIODS`` times."""
    work = [(0, len(symbols))]
    while work:
        a, b = work.pop()
        part = symbols[a:b]
        # Word numbers ascend with first occurrence; within a part only their differences count.
        part = part - part.min()
        often = np.bincount(part)[part] >= PERIODS
        if often.all():
            yield a, b
            continue
        edges = np.flatnonzero(np.diff(often, prepend=False, append=False)).reshape(-1, 2)
        work += [(a + int(x), a + int(y)) for x, y in edges if y - x >= WORDS]


def word_runs(words: list[bytes]) -> np.ndarray:
    """All runs of a document's words: rows of start, length, period, sorted by start and period."""
    if len(words) < WORDS:
        return np.zeros((0, 3), np.int64)
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    symbols = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    found = []
    for a, b in _stretches(symbols):
        own = np.unique(symbols[a:b], return_inverse=True)[1] + 1
        runs = runs_of(own)
        runs[:, 0] += a
        found.append(runs)
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapsed_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return list(itertools.compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))


RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


def find_runs(df: DataFrame, column: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``df`` with the periodic runs of ``column`` and the text without their repetitions.

    Words end at space and the control characters 9 to 13 and are numbered from 0;
    they are compared as they are.  A run is a stretch whose words, ``period``
    apart, are identical, of at least four periods and six words, which no
    neighbouring word extends; its period is the smallest one it has.  ``runs``
    lists them by start and period.  ``collapsed`` has the words, joined by one
    space, without those that any run holds after its first period.

    A null or empty text, or one without words, has no runs and the empty text.
    Repeated rows are treated alike, ties cannot arise, an empty table stays
    empty.  Columns called like the new ones are replaced, all others kept.
    Whole texts are searched; a worker needs about half a kilobyte for each word
    of the longest periodic stretch in one text.
    """
    new = [T.StructField(runs, T.ArrayType(RUN, False)), T.StructField(collapsed, T.StringType())]
    kept = [f for f in df.schema.fields if f.name not in (runs, collapsed)]
    schema = T.StructType([*kept, *new])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
            for a, b in text_chunks(batch.column(column)):
                found, rest = [], []
                for text in texts.slice(a, b - a).to_pylist():
                    words = text.split()
                    found.append(word_runs(words))
                    rest.append(b" ".join(collapsed_words(words, found[-1])))
                flat = np.concatenate(found)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                fields = [pa.field(f.name, pa.int64(), False) for f in RUN.fields]
                rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in flat.T], fields=fields)
                listed = pa.ListArray.from_arrays(pa.array(offsets), rows)
                whole = pa.array(rest, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(a, b - a) for f in kept), listed, whole], names=schema.names)

    return df.mapInArrow(search, schema)
