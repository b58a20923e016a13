"""A stored dataset replayed as a stream, at a steady rate."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridtide.operators.replay import send_slots
from gridtide.sinks.targets import Target, write_batch
from gridtide.streaming.run import start

SLOT = "slot"


def store_slots(df: DataFrame, records_per_second: int, order: Sequence[str], folder: str, stored: bool = False) -> str:
    """Write the records by the second in which each is due, a folder for each second."""
    slots = send_slots(df, records_per_second, order, stored=stored)
    slots.hint("rebalance", SLOT).write.mode("overwrite").partitionBy(SLOT).parquet(folder)
    return folder


def clock(spark: SparkSession, seconds: int = 1) -> DataFrame:
    """A stream of ``slot``: every batch has the next ``seconds`` slots, from 0 on.

    Which batch has which slots is settled by its number, so a batch that is run
    again after a failure sends the same records.
    """
    if seconds < 1:
        raise ValueError("the interval must be at least one second")
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", seconds)
    return ticks.option("numPartitions", 1).load().select(F.col("value").alias(SLOT))


def replay_each_batch(
    spark: SparkSession, folder: str, target: Target | Callable[[DataFrame, int], None], keep_slot: bool = True
) -> Callable[[DataFrame, int], None]:
    """A batch writer for a clock's slots: the records due then, and no others, are read and sent."""
    records = spark.read.parquet(folder)

    def process(ticks: DataFrame, batch_id: int) -> None:
        # A few numbers, one for each second of the interval: naming them prunes all other folders.
        due = [r[SLOT] for r in ticks.collect()]
        rows = records.where(F.col(SLOT).isin(due))
        rows = rows if keep_slot else rows.drop(SLOT)
        if isinstance(target, Target):
            write_batch(rows, target, batch_id)
        else:
            target(rows, batch_id)

    return process


def replay(
    spark: SparkSession,
    folder: str,
    target: Target | Callable[[DataFrame, int], None],
    checkpoint: str,
    every_seconds: int = 1,
    patience_seconds: float = 3600,
) -> StreamingQuery:
    """Replay all stored slots, ``every_seconds`` of them at a time and as often, then stop.

    An interval is never shorter than asked for, so no second gets more than its
    records; one that takes longer delays those after it.
    """
    last = spark.read.parquet(folder).agg(F.max(SLOT)).first()[0]
    batches = 0 if last is None else last // every_seconds + 1
    query = start(clock(spark, every_seconds), replay_each_batch(spark, folder, target), checkpoint, every_seconds)
    begun = time.monotonic()
    try:
        while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < batches - 1):
            if batches == 0:
                break
            if time.monotonic() - begun > patience_seconds:
                raise TimeoutError("the replay has not come to its end")
            query.awaitTermination(0.1)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    return query
