"""The last record of each id between micro-batches, kept as a log with levels.

A batch appends what it knows now of its own ids, as one run; runs that have
become as many as ``FAN`` of about one size are merged into one of the next
size.  A record is thus written again once per level, not once per batch, and a
batch with few ids writes little, however many ids are held.

A run lies in a slot, a folder of its own.  A note for each batch says which
runs hold; it is written last.  A batch reads the note of the batch before and
puts its runs into slots that this note does not name, so a batch that failed
or is run again starts from the same records, and slots of old runs are used
again instead of being deleted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.functions.literals import few_rows

#: Runs of one size that are merged into one.
FAN = 4
#: Rows from which on sizes are told apart.
SMALLEST_RUN = 1024

NEWEST = "_newest"
NOTE = "slot int, newest long, rows long"


@dataclass(frozen=True)
class Run:
    """One stored run: its slot, the last batch that went into it, and its rows."""

    slot: int
    newest: int
    rows: int

    @property
    def level(self) -> int:
        level, size = 0, SMALLEST_RUN * FAN
        while self.rows >= size:
            level, size = level + 1, size * FAN
        return level


def to_merge(runs: Sequence[Run]) -> list[Run]:
    """The newest runs that are to become one now; none if all may stay as they are.

    ``runs`` are in order, the oldest first.  Levels fall from old to new: a
    run takes up smaller ones right before it, and ``FAN`` of one level become
    one.  So there are fewer than ``FAN`` runs of each level, and only
    neighbours in time are merged.
    """
    tail: list[Run] = []
    for run in reversed(runs):
        if run.level > runs[-1].level:
            break
        tail.insert(0, run)
    smaller = any(r.level < runs[-1].level for r in tail)
    return tail if smaller or len(tail) >= FAN else []


class LastRecords:
    """Last records by key in ``folder``; ``keys`` may be empty, then there is one record in all.

    ``schema`` is that of the records.  Null keys are keys like others.
    """

    def __init__(self, folder: str, schema: T.StructType, keys: Sequence[str]) -> None:
        self.folder, self.keys = folder.rstrip("/"), list(keys)
        self.columns = schema.names
        self.stored = T.StructType([*schema.fields, T.StructField(NEWEST, T.LongType())])

    def _note(self, batch_id: int) -> str:
        return f"{self.folder}/note={batch_id % 2}"

    def _slot(self, slot: int) -> str:
        return f"{self.folder}/slot={slot}"

    def runs(self, spark: SparkSession, batch_id: int) -> list[Run]:
        """The runs that held when a batch was done, the oldest first; a few for each level.

        Before the first batch, and after a batch without any records, there are none.
        """
        if batch_id < 0:
            return []
        found = spark.read.schema(f"{NOTE}, batch long").parquet(self._note(batch_id)).collect()
        if {r["batch"] for r in found} - {batch_id}:
            raise RuntimeError(f"the state in {self.folder} does not follow batch {batch_id}")
        return sorted((Run(r["slot"], r["newest"], r["rows"]) for r in found if r["slot"] is not None), key=lambda r: r.newest)

    def _key(self) -> Column:
        return F.struct(*self.keys) if self.keys else F.lit(0)

    def _newest(self, spark: SparkSession, runs: Sequence[Run], only: DataFrame | None = None) -> DataFrame:
        """The newest record of each key in some runs, or of the keys in ``only``."""
        rows = spark.read.schema(self.stored).parquet(*[self._slot(r.slot) for r in runs])
        rows = rows.select("*", self._key().alias("_key"))
        if only is not None:
            rows = rows.join(only, rows["_key"].eqNullSafe(only["_only"]), "left_semi")
        if len(runs) > 1:
            record = F.struct(*[F.col(c) for c in rows.columns if c != "_key"])
            rows = rows.groupBy("_key").agg(F.max_by(record, NEWEST).alias("_record")).select("_record.*")
        return rows.select(*self.columns, NEWEST)

    def of(self, batch: DataFrame, runs: Sequence[Run]) -> DataFrame | None:
        """The records held for the keys of ``batch``; None where nothing is held at all."""
        if not runs:
            return None
        only = batch.select(self._key().alias("_only")).distinct()
        return self._newest(batch.sparkSession, runs, only).select(*self.columns)

    def put(self, records: DataFrame, runs: Sequence[Run], batch_id: int) -> list[Run]:
        """Append the batch's last records, one for each of its keys, and merge; the runs that hold then.

        Runs when it is called; nothing counts until ``note`` is written.
        """
        spark = records.sparkSession
        taken = {r.slot for r in runs}

        def free() -> int:
            slot = next(s for s in range(len(taken) + 1) if s not in taken)
            taken.add(slot)
            return slot

        now = list(runs)
        own = records.select(*self.columns, F.lit(batch_id).cast("long").alias(NEWEST))
        added = self._write(own, free(), batch_id)
        if added.rows:
            now.append(added)
        while merged := to_merge(now):
            whole = self._write(self._newest(spark, merged), free(), batch_id)
            now = [*now[: len(now) - len(merged)], whole]
        return now

    def _write(self, rows: DataFrame, slot: int, batch_id: int) -> Run:
        """One run, counted while it is written; adaptive execution chooses its files by size."""
        counted = Observation()
        rows = rows.hint("rebalance").observe(counted, F.count(F.lit(1)).alias("rows"))
        rows.write.mode("overwrite").parquet(self._slot(slot))
        return Run(slot, batch_id, counted.get.get("rows", 0))

    def note(self, spark: SparkSession, runs: Sequence[Run], batch_id: int) -> None:
        """From now on these runs hold."""
        rows = [(r.slot, r.newest, r.rows, batch_id) for r in runs] or [(None, None, None, batch_id)]
        few_rows(spark, rows, f"{NOTE}, batch long").write.mode("overwrite").parquet(self._note(batch_id))
