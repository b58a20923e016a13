"""A channel for the rows of a stream that come too late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.literals import few_rows
from gridtide.sinks.split import write_split
from gridtide.sinks.targets import Target, write_batch

NOTE = "batch long, newest long"


class Watermark:
    """The greatest event time of all batches so far, less a delay; one number between batches.

    As Spark's own watermark, it moves between batches only: a batch is judged
    by the batches before it, whatever the order of its own rows.
    """

    def __init__(self, folder: str, delay_seconds: float, ts: str = "ts") -> None:
        if delay_seconds < 0:
            raise ValueError("the delay must not be negative")
        self.folder, self.delay, self.ts = folder.rstrip("/"), int(delay_seconds * 1_000_000), ts

    def _note(self, batch_id: int) -> str:
        # Two in turn: a batch that is run again still finds the one before it.
        return f"{self.folder}/note={batch_id % 2}"

    def newest(self, spark: SparkSession, batch_id: int) -> int | None:
        """The greatest event time up to a batch, in microseconds; None before the first row."""
        if batch_id < 0:
            return None
        found = spark.read.schema(NOTE).parquet(self._note(batch_id)).first()
        if found["batch"] != batch_id:
            raise RuntimeError(f"the watermark in {self.folder} does not follow batch {batch_id}")
        return found["newest"]

    def tag(self, df: DataFrame, before: int | None, into: str = "late") -> DataFrame:
        """Add whether a row is behind the watermark that ``before`` gives; a row without a time is not."""
        micros = F.unix_micros(F.col(self.ts).cast("timestamp"))
        late = F.lit(False) if before is None else F.coalesce(micros < before - self.delay, F.lit(False))
        return df.withColumn(into, late)

    def note(self, spark: SparkSession, batch_id: int, before: int | None, seen: int | None) -> None:
        known = [t for t in (before, seen) if t is not None]
        few_rows(spark, [(batch_id, max(known, default=None))], NOTE).write.mode("overwrite").parquet(self._note(batch_id))


def divert_late(
    on_time: Target | Callable[[DataFrame, int], None],
    late: Target,
    delay_seconds: float,
    state_folder: str,
    ts: str = "ts",
    notes: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """A batch writer that sends rows behind the watermark to ``late`` and all others on.

    ``on_time`` is a target, or a batch writer of its own.  A row goes to one of
    both, so what they receive adds up to what was read.  The watermark is kept
    in ``state_folder``; a batch that is run again is judged as before.  With
    ``notes``, and a target for both, the rows of each are counted there.
    """
    mark = Watermark(state_folder, delay_seconds, ts)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = mark.newest(spark, batch_id - 1)
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        rows = mark.tag(batch, before, "_late").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            behind = rows.where("_late").drop("_late")
            others = rows.where("NOT _late").drop("_late")
            if isinstance(on_time, Target):
                write_split({"on_time": (others, on_time), "late": (behind, late)}, batch_id, notes)
            else:
                write_batch(behind, late, batch_id)
                on_time(others, batch_id)
            mark.note(spark, batch_id, before, rows.agg(F.max(micros)).first()[0])
        finally:
            rows.unpersist()

    return process
