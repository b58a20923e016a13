"""Benchmark passages in documents.

Method: winnowing.  Of every window of neighbouring word k-grams the one of
least hash is kept as fingerprint (the rightmost of equals).  With 7-grams in
windows of seven, any passage of 13 words that a document shares with an item
holds a common fingerprint at the same place; each common fingerprint is
extended word by word to the longest shared run, and runs of at least 13 words
count.  Items of fewer words are one window of their own length; for them
every gram of that length is looked up.

Words are digits, A-Z in either case and everything beyond ASCII; they are
compared by 64-bit hashes.  The benchmark is handled in blocks of bounded
size: a block is sent to all tasks, documents never move for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.words import ALNUM, Words, gram_hashes, text_chunks

SPAN = 13
GRAM = 7
#: Words of one block of the benchmark: 8 bytes each, and about as much again for its fingerprints.
BLOCK_WORDS = 2_000_000

HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
ITEMS = T.ArrayType(T.StringType(), False)


def winnow(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Places of the least gram of each valid window of ``width`` grams, each once."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least, at = grams[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, width):
        nearer = grams[j : j + n] <= least
        least[nearer] = grams[j : j + n][nearer]
        at[nearer] = j
    return np.unique((np.arange(n) + at)[valid[:n]])


class Block:
    """Fingerprints of some benchmark items."""

    def __init__(self, items: list[tuple[str, np.ndarray]]) -> None:
        self.short: dict[int, dict[int, list[str]]] = {}
        long = []
        for name, words in items:
            if len(words) >= SPAN:
                long.append((name, words))
            elif len(words):
                key = int(gram_hashes(words, len(words))[0])
                self.short.setdefault(len(words), {}).setdefault(key, []).append(name)
        self.short_keys = {m: np.sort(np.fromiter(x, dtype=np.uint64)) for m, x in self.short.items()}
        self.names = [name for name, _ in long]
        self.first = np.cumsum([0, *(len(w) for _, w in long)])
        self.words = np.concatenate([w for _, w in long]) if long else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(long)), np.diff(self.first))
        grams = gram_hashes(self.words, GRAM)
        ok = owner[: max(0, len(owner) - SPAN + 1)] == owner[SPAN - 1 :] if len(owner) >= SPAN else np.zeros(0, bool)
        at = winnow(grams, ok, SPAN - GRAM + 1)
        order = np.argsort(grams[at], kind="stable")
        self.at, self.prints, self.owner = at[order], grams[at][order], owner

    def runs(self, text: Words) -> Iterator[tuple[int, int, int, str]]:
        """(document, first word, end, item) of shared runs, words counted over the chunk."""
        hashes = text.hashes()
        if len(self.prints) and len(hashes) >= SPAN:
            grams = gram_hashes(hashes, GRAM)
            ok = text.text[: len(hashes) - SPAN + 1] == text.text[SPAN - 1 :]
            at = winnow(grams, ok, SPAN - GRAM + 1)
            low = np.searchsorted(self.prints, grams[at], "left")
            high = np.searchsorted(self.prints, grams[at], "right")
            done: dict[tuple[int, int], int] = {}  # end of the last run on a diagonal of an item
            for k in np.flatnonzero(high > low):
                p = int(at[k])
                doc = int(text.text[p])
                begin, end = int(text.first[doc]), int(text.first[doc + 1])
                for q in map(int, self.at[low[k] : high[k]]):
                    if done.get((q - p, int(self.owner[q])), -1) >= p + GRAM:
                        continue
                    item = int(self.owner[q])
                    back = min(p - begin, q - int(self.first[item]))
                    ahead = min(end - p, int(self.first[item + 1]) - q)
                    unlike = np.flatnonzero(hashes[p - back : p] != self.words[q - back : q])
                    start = p - back + (int(unlike[-1]) + 1 if len(unlike) else 0)
                    unlike = np.flatnonzero(hashes[p : p + ahead] != self.words[q : q + ahead])
                    stop = p + (int(unlike[0]) if len(unlike) else ahead)
                    done[q - p, item] = stop
                    if stop - start >= SPAN:
                        yield doc, start, stop, self.names[item]
        for m, keys in self.short_keys.items():
            grams = gram_hashes(hashes, m)
            if not len(grams):
                continue
            ok = text.text[: len(grams)] == text.text[m - 1 :]
            place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            for p in np.flatnonzero((keys[place] == grams) & ok):
                for name in self.short[m][int(grams[p])]:
                    yield int(text.text[p]), int(p), int(p) + m, name


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _matched(df: DataFrame, column: str, block) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name not in ("n_words", "hits", "items")]
    place = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_kind = pa.list_(pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)]))
        for batch in batches:
            for a, b in text_chunks(batch[column]):
                part = batch.slice(a, b - a)
                text = Words(part[column], ALNUM)
                spans: list[list] = [[] for _ in range(b - a)]
                items: list[set] = [set() for _ in range(b - a)]
                for doc, start, stop, name in block.value.runs(text):
                    first = int(text.first[doc])
                    spans[doc].append((start - first, stop - first))
                    items[doc].add(name)
                found = [[{"start": s, "end": e} for s, e in _united(x)] for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [*(part[n] for n in place), pa.array(text.counts, pa.int64()), pa.array(found, spans_kind), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=[*place, "n_words", "hits", "items"],
                )

    extra = [T.StructField("n_words", T.LongType()), T.StructField("hits", HITS), T.StructField("items", ITEMS)]
    return df.mapInArrow(run, T.StructType([*kept, *extra]))


def item_words(benchmark: DataFrame, item: str = "item_id", column: str = "text") -> DataFrame:
    """(item, words): each item's id as text and its word hashes as bytes; items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch["text"]):
                text = Words(batch["text"].slice(a, b - a), ALNUM)
                hashes = text.hashes()
                packed = [hashes[text.first[i] : text.first[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch["item"].slice(a, b - a), pa.array(packed, pa.binary()), pa.array(text.counts, pa.int64())], names=["item", "words", "n"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(column).alias("text")).filter("item is not null")
    return rows.mapInArrow(run, "item string, words binary, n long").filter("n > 0")


def find_benchmark(df: DataFrame, benchmark: DataFrame, column: str = "text", item: str = "item_id", item_column: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``df`` with ``n_words``, ``hits`` and ``items``.

    ``hits`` are the united runs of words (start, end exclusive, counted in the
    document's words) that lie in shared passages; ``items`` the sorted ids, as
    text, of the items they come from.  Null and empty texts have no words and
    no hits; null item ids and items without words match nothing; repeated rows
    each get the full result; an empty benchmark hits nothing.  Columns already
    called so are replaced.

    A benchmark of more than ``block_words`` words is handled in blocks (items
    dealt by a hash of their id), one pass over the documents for each.  Only
    documents with hits are joined up again, on a hash of the text.
    """
    spark = df.sparkSession
    words = item_words(benchmark, item, item_column).distinct()
    total = words.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))

    def block(i: int):
        rows = words.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i) if blocks > 1 else words
        found = [(r["item"], np.frombuffer(bytes(r["words"]), dtype=np.uint64)) for r in rows.toLocalIterator()]
        return spark.sparkContext.broadcast(Block(sorted(found, key=lambda x: x[0])))

    if blocks == 1:
        return _matched(df, column, block(0))
    first = _matched(df.withColumn("_key", F.xxhash64(column)), column, block(0))
    texts = df.select(F.col(column).alias("text"))
    rest = None
    for i in range(1, blocks):
        found = _matched(texts, "text", block(i)).filter(F.size("hits") > 0).select(F.xxhash64("text").alias("_key"), "hits", "items").distinct()
        rest = found if rest is None else rest.unionByName(found)
    more = rest.groupBy("_key").agg(F.flatten(F.collect_list("hits")).alias("_hits"), F.flatten(F.collect_list("items")).alias("_items"))
    joined = first.join(more, "_key", "left")
    both = F.array_sort(F.concat("hits", F.coalesce("_hits", F.array().cast(HITS))))
    # Runs that touch or overlap become one, in order of their start.
    united = F.aggregate(
        both,
        F.array().cast(HITS),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast(ITEMS)))))
    return joined.withColumn("hits", F.when(F.size(both) > 0, united).otherwise(both)).withColumn("items", items).drop("_key", "_hits", "_items")


def hit_words(hits: str = "hits"):
    """Number of words inside the runs of ``hits``, as a column."""
    return F.aggregate(F.col(hits), F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
