"""Starting, pacing and measuring streaming queries."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gridtide.functions.text import count_text, duration_text
from gridtide.sinks.targets import Target

BatchWriter = Callable[[DataFrame, int], None]

PARTITIONS = "spark.sql.shuffle.partitions"
#: Rows of a stream's whole input for which there is one partition of state.
STATE_ROWS = 1 << 18


def trigger(seconds: int | None) -> dict[str, Any]:
    """A micro-batch every so many seconds; None runs through what there is and stops."""
    if seconds is None:
        return {"availableNow": True}
    if seconds < 1:
        raise ValueError("the interval must be at least one second")
    return {"processingTime": f"{seconds} seconds"}


def records_per_trigger(records_per_second: int, seconds: int) -> int:
    """The source limit that gives a mean rate: so many records every interval."""
    if records_per_second < 1 or seconds < 1:
        raise ValueError("rate and interval must be positive")
    return records_per_second * seconds


def state_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions of a stateful stream over so many rows: one a core at least, never more than the session's shuffles have.

    Every partition stores its state with every batch, however little it is.
    """
    wanted = max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))
    return min(int(spark.conf.get(PARTITIONS)), wanted)


def start(
    df: DataFrame,
    target: Target | BatchWriter,
    checkpoint: str,
    every_seconds: int | None = None,
    name: str | None = None,
    output_mode: str = "append",
    rows: int | None = None,
) -> StreamingQuery:
    """Start a query with its progress kept in ``checkpoint``.

    ``rows`` is about how many rows a stateful query reads in all; without it
    its state has as many partitions as the session's shuffles.
    """
    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if isinstance(target, Target):
        writer = writer.format(target.format).options(**target.options)
    else:
        writer = writer.foreachBatch(target)
    writer = writer.trigger(**trigger(every_seconds))
    if rows is None:
        return writer.start()
    conf = df.sparkSession.conf
    own = conf.get(PARTITIONS)
    conf.set(PARTITIONS, state_partitions(df.sparkSession, rows))
    try:
        return writer.start()  # which copies the session's settings
    finally:
        conf.set(PARTITIONS, own)


def run_to_end(df: DataFrame, target: Target | BatchWriter, checkpoint: str, **kwargs) -> StreamingQuery:
    """Run through all data there is, and return the finished query."""
    query = start(df, target, checkpoint, **kwargs)
    query.awaitTermination()
    return query


def spread(lines: DataFrame, partitions: int) -> DataFrame:
    """Deal rows out evenly; worth its shuffle only where a source has few partitions."""
    return lines.repartition(partitions)


class ProgressSum(StreamingQueryListener):
    """Adds up every progress update of the session's queries, by run.

    A query itself keeps only its newest updates, so sums over those would miss
    the earlier batches of a long run.
    """

    def __init__(self) -> None:
        self._rows: dict[str, int] = defaultdict(int)
        self._millis: dict[str, int] = defaultdict(int)
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        run = str(event.progress.runId)
        self._rows[run] += event.progress.numInputRows
        self._millis[run] += event.progress.durationMs.get("triggerExecution", 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._ended[str(event.runId)].set()

    def of(self, query: StreamingQuery, wait_seconds: float = 60) -> tuple[int, float]:
        """Records and seconds of a finished query; updates arrive in order, its end last."""
        run = str(query.runId)
        if not self._ended[run].wait(wait_seconds):
            raise TimeoutError("the end of the query has not been reported")
        return self._rows[run], self._millis[run] / 1000


def run_measured(
    df: DataFrame, target: Target | BatchWriter, checkpoint: str, **kwargs
) -> DataFrame:
    """Run through all data there is; one row: records read and time spent, over all batches."""
    spark = df.sparkSession
    sums = ProgressSum()
    spark.streams.addListener(sums)
    try:
        found = sums.of(run_to_end(df, target, checkpoint, **kwargs))
    finally:
        spark.streams.removeListener(sums)
    totals = spark.createDataFrame([found], "records bigint, seconds double")
    return totals.withColumns(
        {"shown": count_text(F.col("records")), "duration": duration_text(F.col("seconds"))}
    )
