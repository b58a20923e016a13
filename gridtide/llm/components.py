"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.session import scratch_folder

#: Rows of a few numbers that fill a task.
ROWS = 1 << 16


def filled(df: DataFrame, rows: int, each: int = ROWS) -> DataFrame:
    """``df`` in no more tasks than about ``rows`` rows fill with ``each`` of them, but one for each core.

    What a shuffle made of a few rows is read by a few tasks, and they write a
    few files, however many partitions shuffles have.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new folder below ``spark.checkpoint.dir`` and read again."""
    folder = scratch_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def stored_by(df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
    """The same, dealt to buckets by ``column``: grouping and cogrouping by it finds the rows in place.

    The catalogue needs a name only while the table is made and opened; its files
    stay in the scratch folder.
    """
    spark = df.sparkSession
    name, folder = f"{label}_{uuid.uuid4().hex}", scratch_folder(spark, label)
    writer = df.write.format("parquet").option("path", folder).option("compression", "zstd")
    writer.bucketBy(buckets, column).saveAsTable(name)
    opened = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return opened


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(u, v): every node of ``edges`` that is not the least of its component, with the least.

    ``edges`` has the long columns ``u`` and ``v``; direction, order, loops and
    repeated rows don't matter, rows with a null are left out, and no edges give
    no rows.  Each round hangs the neighbours of every node on the least of
    them, first the greater neighbours and then all others, until nothing
    changes; rounds grow with the logarithm of the largest component.  Every
    round is stored, so a lost executor costs one round at most.  A round's
    tasks follow its edges; ``rows`` says about how many there are at first.
    """
    ordered = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(ordered if rows is None else filled(ordered, rows), "edges")
    before = _state(e)
    while before[0]:
        rows = 2 * before[0]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(filled(large, rows), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        again = filled(hung.unionByName(least.select("u", F.col("m").alias("v"))), rows).distinct()
        e = stored(filled(again, rows), "edges")
        after = _state(e)
        if after == before:
            return e
        before = after
    return e


def relabelled(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by the label that ``labels`` (u, v) has for it, if any."""
    found = df.join(labels.select(F.col("u").alias("_u"), F.col("v").alias("_v")), F.col(column) == F.col("_u"), "left")
    return found.withColumn(column, F.coalesce("_v", column)).drop("_u", "_v")
