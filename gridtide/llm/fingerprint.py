"""Document fingerprints that can be merged, DataFrame functions only.

Method: threshold-scaled sketch.  Of a document's shingle hashes every one
below a fixed fraction of the hash range is kept.  Sketches of different sizes
compare fairly, the union of sketches is the sketch of the joined sets, and
containment of a short document in a long one can be estimated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a shingle, and the share of hashes that is kept: one in so many.
SHINGLE = 5
ONE_IN = 2


def shingle_hashes(df: DataFrame, column: str = "text", out: str = "hashes") -> DataFrame:
    """``df`` with ``out``: hashes of all word shingles of the lower-cased text.

    Words end at space and the control characters 9 to 13.  Fewer words than a
    shingle, but not none, are one shingle; null and empty texts have none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")
    hashed = df.withColumn("__words", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("__words")
    run = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get("__words", i + j) for j in range(SHINGLE))))
    whole = F.array(F.xxhash64("__words"))
    return hashed.withColumn(out, F.when(n >= SHINGLE, run).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))).drop("__words")


def sketch(hashes: Column, one_in: int = ONE_IN) -> Column:
    """The hashes below the threshold, distinct and sorted; the least hash alone where none is.

    The least hash stands in so that short documents can be compared; it takes
    part in ``merge`` only where the other sketch is such a stand-in too.
    """
    bound = -(1 << 63) + (1 << 64) // one_in
    kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < bound)))
    return F.when(F.size(kept) > 0, kept).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>"))


def merge(a: Column, b: Column, one_in: int = ONE_IN) -> Column:
    """The sketch of both documents' shingles together."""
    return sketch(F.concat(a, b), one_in)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles in all shingles of both, 0 to 1; two empty sketches are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; an empty sketch is contained in all."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal hashes joined by blanks."""
    return F.array_join(F.transform(a, lambda h: F.hex(h)), " ")


def fingerprints(df: DataFrame, column: str = "text", out: str = "sketch", one_in: int = ONE_IN) -> DataFrame:
    """``df`` with ``out``, the sketch of each whole text as an array; equal texts have equal sketches.

    Null and empty texts, and texts of blanks only, have the empty sketch.  A
    column already called ``out`` is replaced; all others and repeated rows stay.
    """
    return shingle_hashes(df, column, "__hashes").withColumn(out, sketch(F.col("__hashes"), one_in)).drop("__hashes")


def with_next(df: DataFrame, order: str, columns: list[str], parts: int) -> DataFrame:
    """``df`` with ``next_`` columns: those of the row that follows in ``order``, after the last those of the first.

    The table is cut into ``parts`` ranges of ``order`` of about equal row
    numbers, and each range borrows the row that the next one begins with; no
    window covers the whole table.  Rows of equal ``order`` are ordered by the
    given columns and nulls come first.  A table of one row follows itself.
    """
    picked = F.percentile_approx(order, [k / parts for k in range(1, parts)] or [0.5], 100 * parts)
    nulls = F.count(F.when(F.col(order).isNull(), 1))
    edges = df.agg(F.min(order).alias("low"), F.array_sort(F.array_distinct(picked)).alias("cuts"), nulls.alias("nulls")).first()
    low = edges["low"]
    cuts = [c for c in edges["cuts"] or [] if c != low]
    # Row x is in range k if k cuts are at or below it; the first rows of a range are also shown to the one before.
    at = F.coalesce(F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= F.col(order))), F.lit(0)) if cuts else F.lit(0)
    # The caller's columns travel in a struct, so no name of theirs can clash with those used here.
    rows = df.select(F.struct(*df.columns).alias("own"), F.when(F.col(order).isNull(), 0).otherwise(at).alias("range"))
    key = F.col(f"own.{order}")
    place = lambda r, guest, late: F.struct(r.alias("range"), F.lit(guest).alias("guest"), F.lit(late).alias("late"))
    is_cut = key.isin(cuts) if cuts else F.lit(False)
    is_first = key.isNull() if edges["nulls"] else key == F.lit(low)
    shown = F.array(
        place(F.col("range"), False, 0),
        F.when(F.coalesce(is_cut, F.lit(False)), place(F.col("range") - 1, True, 0)),
        F.when(F.coalesce(is_first, F.lit(False)), place(F.lit(len(cuts)), True, 1)),
    )
    spread = rows.select("own", F.explode(F.filter(shown, lambda s: s.isNotNull())).alias("at")).select("own", "at.*")
    window = Window.partitionBy("range").orderBy("late", key.asc_nulls_first(), *(F.col(f"own.{c}").asc_nulls_first() for c in columns))
    led = spread.select("own", "guest", F.lead(F.struct(*(F.col(f"own.{c}") for c in columns))).over(window).alias("next"))
    return led.filter(~F.col("guest")).select("own.*", *(F.col(f"next.{c}").alias(f"next_{c}") for c in columns))
