"""Row order over a whole table without a single-task sort.

Two needs share this module: the next record of the same id, and the position
of a row in the whole table.  A window per id is the plain way; it breaks down
when one id holds a large share of the rows, or when there is no id at all.
Then the rows are dealt out in ranges of ``(id, order)``, so that a hot id takes
as many ranges as it needs, and every range is cut into pieces of a bounded
number of bytes.  A window runs inside a piece.  Across pieces of a range, and
then across ranges, only their first rows, or a number each, are handed on.

There are never more than ``RANGES`` ranges, so that a shuffle of any table
stays one that the driver can keep track of; beyond that they hold more pieces.

Ranges are stored as a table with one bucket for each, sorted.  What is read
back is already in place: windows and sums per range need neither a second
exchange nor a second sort of the rows.  A task that is run again after a lost
executor sees the same ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.session import scratch_folder

#: The widest shuffle there is, at any size.
RANGES = 20_000
#: Bytes of rows that one task takes in a range while there are fewer ranges than that, and in a piece.
RANGE_BYTES, PIECE_BYTES = 128 << 20, 64 << 20
#: A table without ids is cut finer, to keep every core busy, but not below so many rows.
SMALLEST_RANGE = 1_000
#: Pieces of a given number of rows may be small: beyond ``FEW_RANGES`` they share ranges of so many rows.
FEW_RANGES, SHARED_RANGE = 64, 1 << 14

ROW = "_row"
#: Place of the range, the number its bucket is found by, the piece in it, and the row's place in the range.
RANGE, SEGMENT, PIECE, AT = "_range", "_segment", "_piece", "_at"
_LOW_BITS = (1 << 33) - 1


@dataclass(frozen=True)
class Layout:
    """How a table is cut: ranges in all, and rows in a piece."""

    ranges: int
    piece_rows: int


def row_bytes(kind: T.DataType, value: Column) -> Column:
    """About how many bytes a value takes; nulls count as numbers do."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.StructType):
        size = sum((row_bytes(f.dataType, value.getField(f.name)) for f in kind.fields), F.lit(8))
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        kinds = [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.keyType, kind.valueType]
        each = sum(8 if isinstance(k, T.NumericType) else 32 for k in kinds)
        size = F.greatest(F.size(value), F.lit(0)) * each + 16
    else:
        size = F.lit(16 if isinstance(kind, T.DecimalType) and kind.precision > 18 else 8)
    return F.coalesce(size, F.lit(8)).cast("bigint")


def layout(spark: SparkSession, rows: int, size: int, keyed: bool, rows_per_segment: int | None = None) -> Layout:
    """The cut of a table of so many rows and bytes."""
    if rows_per_segment is not None:
        each = max(1, rows_per_segment)
        most = max(FEW_RANGES, rows // SHARED_RANGE, -(-size // RANGE_BYTES))
        return Layout(min(RANGES, most, max(1, -(-rows // each))), each)
    wanted = -(-size // RANGE_BYTES)
    if not keyed:
        wanted = max(wanted, min(4 * spark.sparkContext.defaultParallelism, rows // SMALLEST_RANGE))
    return Layout(min(RANGES, max(1, wanted)), max(1, PIECE_BYTES * rows // max(1, size)))


def _measured(df: DataFrame, stored: bool, total_rows: int | None) -> tuple[DataFrame, int, int]:
    """``df`` as the column ``ROW``, its rows and its bytes.

    Unless it is ``stored`` already, it is evaluated once: it is written as it
    is, measured on the way, and read back by all that follows.
    """
    spark = df.sparkSession
    rows = df.select(F.struct(*df.columns).alias(ROW))
    size = row_bytes(rows.schema[ROW].dataType, F.col(ROW))
    if not stored:
        seen, folder = Observation(), scratch_folder(spark, "rows")
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(size).alias("size")).write.parquet(folder)
        found = seen.get
        return spark.read.schema(rows.schema).parquet(folder), found.get("rows") or 0, found.get("size") or 0
    if total_rows is not None:
        # A bound from the caller; what its rows take is taken from their types alone.
        return rows, total_rows, total_rows * 16 * len(df.columns)
    total, taken = rows.agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows, total, taken or 0


def _bucket_numbers(spark: SparkSession, buckets: int) -> DataFrame:
    """For each range a number that the bucket function sends to the bucket of the range's place.

    A table's bucket is the hash of its column modulo the buckets, so every range
    gets a bucket, and a file, of its own.  Rows of ranges beyond, if a session
    deals to more of them, share buckets with others.
    """
    numbers = spark.range(32 * buckets).select(F.col("id").cast("int").alias(SEGMENT))
    place = F.pmod(F.hash(SEGMENT), F.lit(buckets)).alias(RANGE)
    return numbers.groupBy(place).agg(F.min(SEGMENT).alias(SEGMENT))


def dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Layout) -> DataFrame:
    """Rows (the column ``ROW``) with their range and place: the one exchange of them."""
    columns = [F.col(f"{ROW}.{c}").asc_nulls_first() for c in [*keys, *order]]
    ranged = rows.repartitionByRange(cut.ranges, *columns).sortWithinPartitions(*columns)
    placed = ranged.select(
        ROW,
        F.spark_partition_id().alias(RANGE),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)).alias(AT),
    )
    numbers = F.broadcast(_bucket_numbers(rows.sparkSession, cut.ranges))
    spare = F.lit(32 * cut.ranges) + F.col(RANGE)
    return placed.join(numbers, RANGE, "left").select(
        ROW,
        RANGE,
        F.coalesce(SEGMENT, spare).cast("int").alias(SEGMENT),
        F.call_function("div", F.col(AT), F.lit(cut.piece_rows)).alias(PIECE),
        AT,
    )


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Layout) -> DataFrame:
    """The same, stored and sorted, a bucket for each range.  Nulls are values like others and come first.

    Runs when it is called.
    """
    spark = rows.sparkSession
    # The catalogue needs a name only while the table is made and opened; its files stay in the scratch folder.
    name, folder = f"ranges_{uuid.uuid4().hex}", scratch_folder(spark, "ranges")
    writer = dealt(rows, keys, order, cut).write.format("parquet").option("path", folder)
    writer.bucketBy(cut.ranges, SEGMENT).sortBy(SEGMENT, PIECE, AT).saveAsTable(name)
    opened = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return opened


def _inside() -> Window:
    return Window.partitionBy(SEGMENT, PIECE).orderBy(AT)


def _pieces() -> Window:
    return Window.partitionBy(SEGMENT).orderBy(PIECE)


def _ranges() -> Window:
    """Over one row for each range, of which there are ``RANGES`` at most."""
    return Window.partitionBy(F.lit(0)).orderBy(RANGE)


def _earlier(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _fields(names: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"{ROW}.{c}") for c in names])


def _out(df: DataFrame, columns: Sequence[str], into: str) -> DataFrame:
    return df.select(*[F.col(f"{ROW}.{c}") for c in columns if c != into], into)


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    *,
    rows_per_segment: int | None = None,
    total_rows: int | None = None,
    stored: bool = False,
    into: str = "next",
) -> DataFrame:
    """Add a struct of ``payload`` taken from the next row of the same key.

    It is null in the last row of a key; null keys are one key.  Without
    ``keys`` the whole table is one chain.  ``order`` must be unique within a
    key.  ``stored`` says that ``df`` merely reads what is stored, so that it may
    be read more than once; otherwise it is evaluated once and stored first.
    ``total_rows`` then spares the count when the caller knows an upper bound.
    """
    keys, order, payload = list(keys), list(order), list(payload)
    rows, total, size = _measured(df, stored, total_rows)
    cut = layout(df.sparkSession, total, size, bool(keys), rows_per_segment)
    if cut.ranges == 1:
        plain = df if stored else rows.select(f"{ROW}.*")
        per_key = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        return plain.withColumn(into, F.lead(F.struct(*[F.col(c) for c in payload])).over(per_key))

    ranged = in_ranges(rows, keys, order, cut)
    follower = F.struct(_fields(keys).alias("key") if keys else F.lit(0).alias("key"), _fields(payload).alias("value"))
    # The row that a piece begins with follows the last row of the piece before it, and so with ranges.
    first = ranged.groupBy(SEGMENT, PIECE).agg(F.min_by(follower, AT).alias("_first"), F.max(RANGE).alias(RANGE))
    over = first.where(F.col(PIECE) == 0).select(SEGMENT, F.lead("_first").over(_ranges()).alias("_over"))
    heads = first.withColumn("_in", F.lead("_first").over(_pieces())).join(over, SEGMENT)
    heads = heads.select(SEGMENT, PIECE, F.coalesce("_in", "_over").alias("_head"))
    # The window comes first: it finds the rows as they were stored, and leaves them so for the join.
    led = ranged.withColumn("_lead", F.lead(follower).over(_inside())).join(heads, [SEGMENT, PIECE])
    led = led.withColumn("_then", F.coalesce("_lead", "_head"))
    own_key = _fields(keys) if keys else F.lit(0)
    same = own_key.eqNullSafe(F.col("_then.key")) & F.col("_then").isNotNull()
    return _out(led.withColumn(into, F.when(same, F.col("_then.value"))), df.columns, into)


def _whole_order(
    df: DataFrame, order: Sequence[str], rows_per_segment: int | None, total_rows: int | None, stored: bool
) -> DataFrame:
    rows, total, size = _measured(df, stored, total_rows)
    return in_ranges(rows, [], order, layout(df.sparkSession, total, size, False, rows_per_segment))


def with_position(
    df: DataFrame,
    order: Sequence[str],
    *,
    rows_per_segment: int | None = None,
    total_rows: int | None = None,
    stored: bool = False,
    into: str = "position",
) -> DataFrame:
    """Add the row's position, from 0, in the order of the whole table."""
    ranged = _whole_order(df, order, rows_per_segment, total_rows, stored)
    # Inside a range the place is known since the range was sorted; only whole ranges are summed.
    sizes = ranged.groupBy(SEGMENT).agg(F.count(F.lit(1)).alias("_size"), F.max(RANGE).alias(RANGE))
    starts = sizes.select(SEGMENT, F.coalesce(F.sum("_size").over(_earlier(_ranges())), F.lit(0)).alias("_start"))
    placed = ranged.join(starts, SEGMENT).withColumn(into, F.col(AT) + F.col("_start"))
    return _out(placed, df.columns, into)


def with_max_before(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    *,
    rows_per_segment: int | None = None,
    total_rows: int | None = None,
    stored: bool = False,
    into: str = "max_before",
) -> DataFrame:
    """Add the largest ``value`` over all earlier rows, null in the first."""
    ranged = _whole_order(df, order, rows_per_segment, total_rows, stored)
    own = F.col(f"{ROW}.{value}")
    tops = ranged.groupBy(SEGMENT, PIECE).agg(F.max(own).alias("_top"), F.max(RANGE).alias(RANGE))
    by_range = tops.groupBy(SEGMENT).agg(F.max("_top").alias("_top"), F.max(RANGE).alias(RANGE))
    before = by_range.select(SEGMENT, F.max("_top").over(_earlier(_ranges())).alias("_before"))
    carried = tops.withColumn("_in", F.max("_top").over(_earlier(_pieces()))).join(before, SEGMENT)
    carried = carried.select(SEGMENT, PIECE, F.greatest("_in", "_before").alias("_carried"))
    seen = ranged.withColumn("_own", F.max(own).over(_earlier(_inside()))).join(carried, [SEGMENT, PIECE])
    return _out(seen.withColumn(into, F.greatest("_own", "_carried")), df.columns, into)
