"""Interpolation across micro-batches.

Between batches only the last record of each id is kept, as a log with levels
(``streaming/state.py``).  A batch is then the batch operator over "records held
for its ids, then new records": the pairs become the output, and the records
that found no successor are what the log is given.  Records of other ids are
not written again.  A hot id is cut into ranges as in the batch operator, and no
group of rows passes through Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.operators.densify import NEXT, Interp, check_steps, expand_pairs, interpolation_columns
from gridtide.operators.order import with_next
from gridtide.sinks.targets import Target, write_batch
from gridtide.streaming.state import LastRecords

NEW = "_new"


def interpolate_each_batch(
    schema: T.StructType,
    n: int,
    interps: Sequence[Interp],
    id_cols: Sequence[str],
    order: Sequence[str],
    target: Target,
    state_folder: str,
    rows_per_segment: int | None = None,
) -> Callable[[DataFrame, int], None]:
    """A batch writer that interpolates a stream of records with the given schema.

    A batch that is run again after a failure starts from the records that the
    batch before it left, and gives the same rows.
    """
    if not interps:
        raise ValueError("at least one interpolator required")
    check_steps(n)
    columns = schema.names
    state = LastRecords(state_folder, schema, id_cols)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            runs = state.runs(spark, batch_id - 1)
            rows = new.withColumn(NEW, F.lit(True))
            held = state.of(new, runs)
            if held is not None:
                rows = held.withColumn(NEW, F.lit(False)).unionByName(rows)
            # A held record came before every record of this batch, whatever its time.
            paired = with_next(
                rows,
                id_cols,
                [NEW, *order],
                [s.column for s in interps],
                rows_per_segment=rows_per_segment,
                stored=True,
                into=NEXT,
            ).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                now = state.put(paired.where(F.col(NEXT).isNull()), runs, batch_id)
                output = expand_pairs(paired, n, interpolation_columns(interps, n)).select(*columns)
                write_batch(output, target, batch_id)
                state.note(spark, now, batch_id)
            finally:
                paired.unpersist()
        finally:
            new.unpersist()

    return process
