"""Document quality by gradient-boosted trees over document statistics.

Method: histogram gradient boosting.  Statistics are cut into quantile bins;
trees of fixed depth are grown level by level from histograms of gradients,
and flattened into arrays that numpy walks for all documents and trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.words import SPACED, Words, forget_others, give_back, gram_hashes, mix, text_chunks

#: Labelled rows the trees are fitted on, at most: those of least hash of their id.
SAMPLE_ROWS = 20_000

_KINDS = ("lower", "digit", "space", "newline", "stop", "comma", "mark", "bang", "bar", "bracket", "quote", "control", "beyond", "upper")


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, _KINDS.index("mark"), dtype=np.int64)
    members = {
        "lower": range(ord("a"), ord("z") + 1),
        "upper": range(ord("A"), ord("Z") + 1),
        "digit": range(ord("0"), ord("9") + 1),
        "space": b" \t",
        "newline": b"\n\r",
        "stop": b".;:",
        "comma": b",",
        "bang": b"!?",
        "bar": b"|",
        "bracket": b"()[]{}<>",
        "quote": b"\"'`",
        "control": [*range(9), 11, 12, *range(14, 32), 127],
        "beyond": range(128, 256),
    }
    for name, codes in members.items():
        kind[list(codes)] = _KINDS.index(name)
    return kind


_KIND_OF = _byte_kinds()


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values in each of ``n`` groups."""
    if not len(group):
        return np.zeros(n)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])))
    return np.bincount(g[new], minlength=n).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """Statistics of whole texts, a row each; null and empty texts give a row of zeros."""
    n = len(column)
    text = column.cast(pa.large_string()).fill_null("")
    words = Words(text, SPACED)
    raw = text.buffers()
    base = np.frombuffer(raw[1], dtype=np.int64)[text.offset]
    size = int(words.offsets[-1])
    data = np.frombuffer(raw[2], dtype=np.uint8)[base : base + size] if size else np.zeros(0, np.uint8)
    lengths = np.diff(words.offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(words.offsets))
    kinds = np.bincount(owner * len(_KINDS) + _KIND_OF[data], minlength=n * len(_KINDS)).reshape(n, len(_KINDS)).astype(float)
    count = words.counts.astype(float)
    span = (words.ends - words.starts).astype(float)
    hashes = words.hashes()
    per_text = lambda x: np.bincount(words.text, weights=x, minlength=n)
    mean = _ratio(per_text(span), count)
    spread = np.sqrt(np.maximum(0, _ratio(per_text(span * span), count) - mean * mean))
    longest = np.zeros(n)
    np.maximum.at(longest, words.text, span)
    ends_odd = per_text(np.isin(_KIND_OF[data[words.ends - 1]], [_KINDS.index(k) for k in ("mark", "bar", "bang")]).astype(float)) if len(span) else np.zeros(n)
    starts_upper = per_text((_KIND_OF[data[words.starts]] == _KINDS.index("upper")).astype(float)) if len(span) else np.zeros(n)
    grams = gram_hashes(hashes, 3)
    inside = words.text[: len(grams)] == words.text[2:] if len(grams) else np.zeros(0, bool)
    n_grams = np.bincount(words.text[: len(grams)][inside], minlength=n).astype(float)
    # Lines: a line is known by the sum of its words' hashes, each scrambled by its place.
    line = np.cumsum(data == 10)
    line_of = line[words.starts] if len(span) else np.zeros(0, np.int64)
    fresh = np.concatenate(([True], (line_of[1:] != line_of[:-1]) | (words.text[1:] != words.text[:-1]))) if len(span) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    lines = np.add.reduceat(mix(hashes + (np.arange(len(hashes)) - first[np.cumsum(fresh) - 1]).astype(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)
    n_lines = np.bincount(words.text[first], minlength=n).astype(float)
    short = np.diff(np.append(first, len(hashes))) <= 3
    columns = [
        np.log1p(lengths),
        np.log1p(count),
        mean,
        spread,
        np.log1p(longest),
        _ratio(_distinct(words.text, hashes, n), count),
        _ratio(_distinct(words.text[: len(grams)][inside], grams[inside], n), n_grams),
        _ratio(ends_odd, count),
        _ratio(starts_upper, count),
        np.log1p(n_lines),
        _ratio(count, n_lines),
        _ratio(_distinct(words.text[first], lines, n), n_lines),
        _ratio(np.bincount(words.text[first], weights=short.astype(float), minlength=n), n_lines),
        _ratio(per_text((span <= 3).astype(float)), count),
        *(_ratio(kinds[:, j], lengths) for j in range(len(_KINDS))),
        _ratio(kinds[:, _KINDS.index("upper")], kinds[:, _KINDS.index("upper")] + kinds[:, _KINDS.index("lower")]),
    ]
    return np.column_stack([np.asarray(c, dtype=float) for c in columns]) if n else np.zeros((0, len(columns)))


@dataclass
class Trees:
    """Boosted trees of one depth, flattened; node j of a tree has the children 2j+1 and 2j+2."""

    depth: int
    start: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes: go right where the value is greater
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, leaf_rows: int = 10, ridge: float = 1.0) -> Trees:
    """Fit by Newton steps on the logistic loss; rows in any order give the same trees up to rounding.

    Without rows the score is 0.5; with one label only it is close to that label.
    """
    inner = 2**depth - 1
    share = np.clip(y.mean(), 0.001, 0.999) if len(y) else 0.5
    out = Trees(depth, float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max():
        return out
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])  # bin b: value <= edges[b]
    features, cuts, leaves = [], [], []
    raw = np.full(n, out.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            base, many = 2**level - 1, 2**level
            best = np.full(many, 1e-6)
            for j in range(width):
                if not len(edges[j]):
                    continue
                m = len(edges[j]) + 1
                key = (node - base) * m + binned[:, j]
                g, h, c = (np.cumsum(np.bincount(key, weights=w, minlength=many * m).reshape(many, m), axis=1) for w in (grad, hess, None))
                gl, hl, cl = g[:, :-1], h[:, :-1], c[:, :-1]
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < leaf_rows) | (ct - cl < leaf_rows)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(many), k]
                for i in np.flatnonzero(top > best):
                    best[i], feature[base + i], cut[base + i] = top[i], j, edges[j][k[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        g, h = (np.bincount(at, weights=w, minlength=inner + 1) for w in (grad, hess))
        leaf = rate * g / (h + ridge)
        raw += leaf[at]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(depth, out.start, np.array(features), np.array(cuts), np.array(leaves))


def learn_quality(documents: DataFrame, labels: DataFrame, document: str = "doc_id", column: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit the trees on at most ``sample_rows`` labelled documents.

    ``labels`` holds the rows to learn from; those of least hash of their id are
    taken, so the sample does not depend on the layout.  Rows without id, label
    or document are left out.  The sample is small by its bound and is sent to
    all tasks; only statistics of its documents come to the driver.
    """
    picked = labels.select(F.col(document).alias("_id"), F.col(label).cast("int").alias("_y")).dropna().distinct()
    picked = picked.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_y").limit(sample_rows)
    texts = documents.select(F.col(document).alias("_id"), F.col(column).alias("_text"))
    rows = texts.join(F.broadcast(picked), "_id").select("_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            for a, b in text_chunks(batch["_text"]):
                x = [r.tobytes() for r in statistics(batch["_text"].slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([batch["_y"].slice(a, b - a), pa.array(x, pa.binary())], names=["y", "x"])

    found = rows.mapInArrow(run, "y int, x binary").toArrow()
    y = found["y"].to_numpy().astype(float)
    x = np.array([np.frombuffer(r.as_py()) for r in found["x"]]) if len(y) else np.zeros((0, 1))
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, np.int64)  # whatever order the rows arrive in
    return fit_trees(x[order], y[order])


def score_quality(df: DataFrame, trees: Trees, column: str = "text", score: str = "score") -> DataFrame:
    """``df`` with ``score``, the trees' probability of label 1 for each whole text.

    Null and empty texts are scored by their (zero) statistics.  A column already
    called like ``score`` is replaced; all others and repeated rows stay.
    """
    kept = [f for f in df.schema.fields if f.name != score]
    place = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            for a, b in text_chunks(batch[column]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part[n] for n in place), pa.array(trees.score(statistics(part[column])))], names=[*place, score])
            give_back()

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(score, T.DoubleType())]))
