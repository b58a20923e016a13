"""Shards of near equal size that keep groups of rows together.

Method: minimax contiguous partition.  Rows are put in order of their group;
a shard is a run of whole groups.  The smallest capacity with which the groups
fit into the wanted number of shards is found by binary search, each try
checked greedily: fill a shard to the last group that fits, then open the next.

Only places where a cut may be (the ends of groups, as running sums of sizes)
matter for the check.  The driver never holds all of them: it gets them counted
by cells, at most ``CELLS`` at a time, searches with bounds, and asks for finer
cells only around places where the bounds still leave the answer open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.session import scratch_folder

#: Rows the driver takes in one go.
CELLS = 1 << 16


class Places:
    """Possible cuts by cells: the least and the greatest of each cell, and how many it holds."""

    def __init__(self, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(low, kind="stable")
        self.low, self.high, self.count = low[order], high[order], count[order]

    def last(self, x: int, hopeful: bool) -> int:
        """A bound for the last place at or before ``x`` (0 if there is none): from above if hopeful, else from below."""
        i = int(np.searchsorted(self.high, x, "right"))
        if i < len(self.low) and self.low[i] <= x:
            return x if hopeful and self.count[i] > 2 else int(self.low[i])
        return int(self.high[i - 1]) if i else 0

    def path(self, capacity: int, shards: int, total: int, hopeful: bool) -> list[int] | None:
        """Ends of the greedily filled shards, or None if the last group stays out."""
        at, ends = 0, []
        for _ in range(shards):
            at = self.last(min(total, at + capacity), hopeful)
            ends.append(at)
        return ends if at >= total else None

    def least(self, shards: int, total: int, hopeful: bool) -> int:
        """The smallest capacity whose greedy check passes."""
        low, high = max(1, -(-total // shards)), total
        while low < high:
            middle = (low + high) // 2
            if self.path(middle, shards, total, hopeful) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def open_cells(self, first: list[int], last: list[int]) -> np.ndarray:
        """Cells with unseen places between the first and the last possible end of some shard."""
        seen = np.zeros(len(self.low), dtype=bool)
        for a, b in zip(first, last, strict=True):
            seen[np.searchsorted(self.high, a, "left") : np.searchsorted(self.low, b, "right")] = True
        return np.flatnonzero(seen & (self.count > 2))

    def known(self) -> np.ndarray:
        return np.unique(np.concatenate((self.low, self.high)))


def even_cuts(places: np.ndarray, capacity: int, shards: int, total: int) -> list[int]:
    """Ends of all shards but the last, each the place nearest to an even share of what is left.

    No shard exceeds ``capacity``: a cut is never so early that the rest would not fit.
    """
    latest = [total]
    for _ in range(shards - 1):
        x = latest[-1] - capacity
        latest.append(int(places[np.searchsorted(places, x, "left")]) if x > 0 else 0)
    latest.reverse()  # latest[k]: the least end of shard k with which the rest fits
    at, cuts = 0, []
    for k in range(shards - 1):
        aim = at + (total - at) / (shards - k)
        low, high = max(at, latest[k]), at + capacity
        inside = places[np.searchsorted(places, low, "left") : np.searchsorted(places, high, "right")]
        at = int(inside[np.abs(inside - aim).argmin()]) if len(inside) else low
        cuts.append(at)
    return cuts


def _cells(ends: DataFrame, ranges: list[tuple[int, int]], most: int) -> Places:
    """Places of ``ends`` inside the ranges (first, last; apart and in order), in at most ``most`` cells."""
    first, last = (np.array(x, dtype=np.int64) for x in zip(*ranges, strict=True))
    fan = max(1, most // len(ranges))
    width = np.maximum(1, -(-(last - first + 1) // fan))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each place's range, found by binary search, and its cell in it."""
        for batch in batches:
            place = batch["place"].to_numpy()
            k = np.searchsorted(first, place, "right") - 1
            inside = (k >= 0) & (place <= last[k])
            place, k = place[inside], k[inside]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first[k], (place - first[k]) // width[k], place)], names=["a", "cell", "place"])

    inside = ends.select("place").mapInArrow(dealt, "a long, cell long, place long")
    found = inside.groupBy("a", "cell").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("n")).toPandas()
    return Places(*(found[c].to_numpy(dtype=np.int64) for c in ("low", "high", "n")))


def find_cuts(ends: DataFrame, shards: int, total: int, most: int = CELLS) -> tuple[int, list[int]]:
    """The smallest capacity and the cuts, from a frame with the column ``place``."""
    if not total:
        return 0, [0] * (shards - 1)
    places = _cells(ends, [(1, total)], most)
    while True:
        low, high = places.least(shards, total, True), places.least(shards, total, False)
        if low == high:
            return high, even_cuts(places.known(), high, shards, total)
        first = [places.last(min(total, x), False) for x in _reached(places, low, shards, total)]
        last = places.path(high, shards, total, True)
        open_ = places.open_cells(first, last)
        finer = _cells(ends, [(int(places.low[i]), int(places.high[i])) for i in open_[: most // 2]], most)
        kept = np.ones(len(places.low), dtype=bool)
        kept[open_[: most // 2]] = False
        places = Places(*(np.concatenate((getattr(places, n)[kept], getattr(finer, n))) for n in ("low", "high", "count")))


def _reached(places: Places, capacity: int, shards: int, total: int) -> list[int]:
    """How far the shards reach at least, whether or not all groups fit."""
    at, out = 0, []
    for _ in range(shards):
        at = places.last(min(total, at + capacity), False)
        out.append(at)
    return out


def shard_rows(df: DataFrame, group: str, order: str, size: str, shards: int) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Rows with equal ``group`` go to the same shard; null groups are one group.
    Groups are in order of ``group``, their rows in order of ``order`` (nulls
    first); repeated rows take slots of their own.  ``size`` counts as 1 where it
    is null or less.  A group larger than an even share makes
    its shard larger, since groups are not split.  An empty frame gives an empty
    frame.  Columns already called ``shard`` or ``slot`` are replaced.

    Pass narrow rows: every column of ``df`` is shuffled once and stored in the
    shared scratch folder, in order.  A group may hold any share of the rows; its
    rows are spread over tasks by ``order``.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    weight = F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1)).cast("long")
    folder = scratch_folder(spark, "shards")
    # The caller's columns travel in a struct, so no name of theirs can clash with those used here.
    narrow = df.select(F.struct(*kept).alias("own"), F.col(group).alias("group"), F.col(order).alias("order"), weight.alias("weight"))
    keys = [F.col("group").asc_nulls_first(), F.col("order").asc_nulls_first()]
    numbered = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = numbered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    numbered.write.parquet(folder)
    rows = spark.read.parquet(folder)
    # One row for each partition of the stored table: where it begins, and the group that follows it.
    over = Window.orderBy("part")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(
        F.sum("weight").alias("sum"), F.count("*").alias("rows"), F.min("at").alias("first_at"), F.min_by(F.struct("group"), "at").alias("first_group")
    )
    parts = parts.select(
        "part",
        "first_at",
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("weight_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.lead("first_group").over(over).alias("next_group"),
    )
    own = Window.partitionBy("part").orderBy("at")
    placed = rows.join(F.broadcast(parts), "part").select(
        "own",
        "group",
        "weight",
        (F.col("weight_before") + F.sum("weight").over(own.rowsBetween(Window.unboundedPreceding, 0))).alias("place"),
        (F.col("rows_before") + F.col("at") - F.col("first_at")).alias("row"),
        F.coalesce(F.lead(F.struct("group")).over(own), "next_group").alias("after"),
    )
    ends = placed.filter(~F.struct("group").eqNullSafe(F.col("after"))).select("place")
    total = rows.agg(F.sum("weight")).first()[0] or 0
    _, cuts = find_cuts(ends, shards, total)
    begin = F.col("place") - F.col("weight")
    number = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c <= begin)) if cuts else F.lit(0)
    sharded = placed.select("own", "row", number.cast("int").alias("shard"))
    first = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))
    return sharded.join(F.broadcast(first), "shard").select("own.*", "shard", (F.col("row") - F.col("first_row")).alias("slot"))
