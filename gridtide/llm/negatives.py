"""Hard negatives: for an anchor and a positive the best rows of other labels that are not too alike.

Method: anchor spanning-tree bounds.  Anchors near each other are linked by a
minimum spanning tree.  A row's score at an anchor is an inner product, so its
score at the anchor's child differs by at most the length of the edge times the
norm of the row.  Walking the tree from its root, every row has a lower and an
upper bound at each anchor, and only rows whose bounds overlap the wanted window
of scores, and could be among the best in it, are scored again; a rescored row
hands exact bounds on.

All anchors meet all rows, in blocks: a bundle of trees and a group of rows at a
time in one task, the rows slice by slice.  A block keeps only its best rows of
each window, and the best of all blocks are chosen by rank.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.words import give_back
from gridtide.operators.order import with_position
from gridtide.session import scratch_folder

#: Anchors in one spanning tree, and in the trees that one task handles.
TREE, BUNDLE = 2048, 16384
#: Rows that one task meets at most, and in one go.
GROUP, SLICE = 65536, 2048
#: Rows that are worth a task of their own.
LEAST_GROUP = 1024
#: Scores of more bits would not be exact.
EXACT = 1 << 53

FOUND = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])


def whole_vectors(vector: str | Column, scale: int = 256) -> Column:
    """Each component as ``floor(scale * x)``; null for a null vector or one with a null or non-finite component."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree grown from row 0: rows in order of joining, each one's parent's place, and the edges' lengths."""
    n = len(vectors)
    squares = (vectors * vectors).sum(axis=1)
    near, parent = np.full(n, np.inf), np.full(n, -1)
    order, waiting, row = np.empty(n, np.int64), np.ones(n, bool), 0
    above, edge = np.full(n, -1), np.zeros(n)
    place = np.empty(n, np.int64)
    for k in range(n):
        order[k], waiting[row], place[row] = row, False, k
        if k:
            above[k], edge[k] = place[parent[row]], np.sqrt(near[row])
        distance = squares + squares[row] - 2 * (vectors @ vectors[row])
        closer = waiting & (distance < near)
        near[closer], parent[closer] = distance[closer], row
        row = int(np.where(waiting, near, np.inf).argmin())
    return order, above, edge


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; components that a shorter one lacks are 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lists), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class Search:
    """Best rows of each anchor's windows, over slices of rows handed in one after the other."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, above: np.ndarray, edge: np.ndarray, windows: Sequence[Sequence[tuple[float, float]]], same: bool, k: int) -> None:
        self.ids, self.labels, self.vectors, self.above, self.edge = ids, labels, vectors, above, edge
        self.windows, self.same, self.k = windows, same, k
        none = np.zeros((2, 0), np.int64)
        #: For each anchor and window the best rows so far: ids and scores, best first.
        self.best = [[none] * len(w) for w in windows]
        self.asked = self.rescored = 0

    def _wanted(self, i: int, low: np.ndarray, high: np.ndarray, able: np.ndarray) -> np.ndarray:
        """Rows whose bounds overlap a window of anchor ``i`` and reach the best that are known for it."""
        wanted = np.zeros(len(able), bool)
        for (a, b), best in zip(self.windows[i], self.best[i], strict=True):
            inside = able & (low >= a) & (high <= b)
            least = max(a, _kth_largest(low[inside], self.k), best[1, -1] if best.shape[1] == self.k else -np.inf)
            wanted |= able & (high >= least) & (low <= b)
        return wanted

    def _keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        for w, (a, b) in enumerate(self.windows[i]):
            inside = (scores >= a) & (scores <= b)
            if inside.any():
                all_ = np.concatenate((self.best[i][w], np.stack((ids[inside], scores[inside].astype(np.int64)))), axis=1)
                self.best[i][w] = all_[:, np.lexsort((all_[0], -all_[1]))[: self.k]]

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Rows to choose from, at most a slice of them."""
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        bounds = np.empty((2, len(self.ids), len(ids)))
        for i, parent in enumerate(self.above):
            able = (labels == self.labels[i]) if self.same else (labels != self.labels[i])
            if self.same:
                able &= ids != self.ids[i]
            low, high = bounds[0, i], bounds[1, i]
            if parent < 0:
                wanted = np.ones(len(ids), bool)
            else:
                reach = np.ceil(self.edge[i] * norms) + 1  # above the product, whatever its rounding
                np.subtract(bounds[0, parent], reach, out=low)
                np.add(bounds[1, parent], reach, out=high)
                wanted = self._wanted(i, low, high, able)
            at = np.flatnonzero(wanted)
            scores = vectors[at] @ self.vectors[i]
            low[at] = high[at] = scores
            self.asked += len(ids)
            self.rescored += len(at)
            chosen = able[at]
            if chosen.any():
                self._keep(i, ids[at[chosen]], scores[chosen])

    def found(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for i, windows in enumerate(self.best):
            for w, best in enumerate(windows):
                if best.shape[1]:
                    yield i, w, best


def _grow_tree(dims: int, table: pa.Table) -> pa.Table:
    vectors = _matrix(table["v"], dims)
    order, above, edge = spanning_tree(vectors)
    out = table.take(pa.array(order))
    return out.append_column("place", pa.array(np.arange(len(order)))).append_column("above", pa.array(above)).append_column("edge", pa.array(edge))


def _search_block(dims: int, k: int, same: bool, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The best rows of one group for the anchors of one bundle."""
    out = {f.name: [] for f in FOUND.fields}
    if anchors.num_rows and rows.num_rows:
        anchors = anchors.sort_by([("tree", "ascending"), ("place", "ascending")])
        of = {c: anchors[c].to_numpy() for c in ("tree", "anchor", "id", "label", "above", "edge")}
        points, windows = _matrix(anchors["v"], dims), [[(w["low"], w["high"]) for w in ws] for ws in anchors["windows"].to_pylist()]
        ids, labels, vectors = rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"], dims)
        if np.abs(points).max(initial=0) * np.abs(vectors).max(initial=0) * dims >= EXACT:
            raise ValueError("scores of these vectors need more than 53 bits")
        edges = np.flatnonzero(np.diff(of["tree"], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(points)], strict=True):
            search = Search(of["id"][a:b], of["label"][a:b], points[a:b], of["above"][a:b], of["edge"][a:b], windows[a:b], same, k)
            for at in range(0, len(ids), SLICE):
                search.add(ids[at : at + SLICE], labels[at : at + SLICE], vectors[at : at + SLICE])
            for i, w, best in search.found():
                n = best.shape[1]
                for name, values in zip(out, (np.full(n, of["anchor"][a + i]), np.full(n, w), best[0], best[1]), strict=True):
                    out[name].append(values)
        give_back()
    kinds = {"window": pa.int32()}
    return pa.table({name: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)).cast(kinds.get(name, pa.int64())) for name, v in out.items()})


def _best_rows(rows: DataFrame, anchors: DataFrame, bundles: int, groups: int, dims: int, k: int, same: bool) -> DataFrame:
    """``anchor, window, rank, id, score``: the best ``k`` rows of each anchor's windows."""
    dealt = rows.withColumn("group", F.expr(f"monotonically_increasing_id() % {groups}")).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    asked = anchors.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def block(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        return _search_block(dims, k, same, anchors, rows)

    found = asked.groupBy("bundle", "group").cogroup(dealt.groupBy("bundle", "group")).applyInArrow(block, FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_negatives(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of a table ``vec_id, label, v`` of whole-number vectors (see :func:`whole_vectors`).

    Rows score by inner product with an anchor, ties by the smaller id.  An
    anchor's positives are its first ``positives`` rows of the same label and
    another id.  For each of them the first ``negatives`` rows of other labels are
    returned whose score is from ``low`` to ``high`` percent of the positive's:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    A positive of negative score has no such window.

    Rows with a null id, label or vector take no part.  Rows are told apart by
    their place in the table: repeated rows fill places of their own, and each
    repeated anchor is an anchor.  A vector shorter than others lacks components,
    which count as 0.  An empty table, one without anchors and one of a single
    label give an empty frame.  Other columns are not read.  Scores must be below
    2**53, else the job fails.

    Runs when it is called, but for the last step: the anchors' trees and their
    positives are stored in the shared scratch folder.  Every row is sent once for
    each bundle of anchors, every anchor once for each group of rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v", is_anchor.alias("is_anchor"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    total, count, dims = rows.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("v"))).first()
    bundles = max(1, -(-count // BUNDLE))
    spread = min(-(-total // LEAST_GROUP), 4 * spark.sparkContext.defaultParallelism)
    groups = max(1, -(-total // GROUP), spread)
    dims = max(1, dims or 1)

    # Anchors of one label and the same signs of their first components are likely to be near each other.
    signs = F.aggregate(F.slice("v", 1, 12), F.lit(0), lambda a, x: a * 2 + (x > 0).cast("int"))
    anchors = rows.filter("is_anchor").select("id", "label", "v", signs.alias("signs"))
    placed = with_position(anchors, ["label", "signs", "id"], total_rows=count, into="anchor")
    placed = placed.withColumns({"tree": F.expr(f"anchor div {TREE}"), "bundle": F.expr(f"cast(anchor div {BUNDLE} as int)")}).drop("signs")
    schema = T.StructType([*placed.schema.fields, T.StructField("place", T.LongType()), T.StructField("above", T.LongType()), T.StructField("edge", T.DoubleType())])
    trees_folder, positives_folder = scratch_folder(spark, "anchor-trees"), scratch_folder(spark, "positives")

    def grow(anchors: pa.Table) -> pa.Table:
        return _grow_tree(dims, anchors)

    placed.groupBy("tree").applyInArrow(grow, schema).write.parquet(trees_folder)
    trees = spark.read.parquet(trees_folder)

    window = lambda a, b: F.struct(a.cast("double").alias("low"), b.cast("double").alias("high"))
    rows = rows.drop("is_anchor")
    all_ = F.array(window(F.lit(float("-inf")), F.lit(float("inf"))))
    _best_rows(rows, trees.withColumn("windows", all_), bundles, groups, dims, positives, True).write.parquet(positives_folder)
    chosen = spark.read.parquet(positives_folder)
    score = F.col("score").cast("decimal(20,0)")
    lowest, highest = F.ceil(score * low / 100), F.floor(score * high / 100)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", window(lowest, highest).alias("window")))), lambda x: x["window"])
    windows = chosen.groupBy("anchor").agg(listed.alias("windows"))
    best = _best_rows(rows, trees.join(windows, "anchor"), bundles, groups, dims, negatives, False)
    pairs = chosen.join(trees.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor", "anchor_id", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    negatives_ = best.select("anchor", "window", F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(negatives_, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
