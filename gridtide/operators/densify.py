"""Densification: more records from the same readings, by copying or interpolating."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.once import with_columns_once
from gridtide.operators.order import with_next
from gridtide.operators.parse import SEPARATOR, strict_timestamp
from gridtide.schemas import TIMESTAMP_FORMAT

STEP = "_step"
NEXT = "_next"

# The type codes and the kinds a column can be interpolated as.
NONE, MULTIPLY, INTERPOLATE = 0, 1, 2
KINDS = ("double", "integer", "long", "date")

# (earlier record, later record, step column, number of steps) -> output column
Kernel = Callable[[Column, Column, Column, int], Column]


@dataclass(frozen=True)
class Interp:
    """How one column is interpolated; ``fmt`` renders a date as text."""

    column: str
    kind: str
    fmt: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind: {self.kind}")


@dataclass(frozen=True)
class FieldInterp:
    """How one field of a text line is interpolated."""

    position: int
    kind: str
    fmt: str | None = None


def parse_spec(spec: str) -> FieldInterp | None:
    """``position;type[;dateFormat]``; a type that is not known gives None."""
    parts = spec.split(";")
    if len(parts) < 2:
        raise ValueError(f"not an interpolator: {spec!r}")
    kind = parts[1].lower()
    if kind not in KINDS:
        return None
    if kind == "date" and len(parts) < 3:
        raise ValueError(f"a date interpolator needs a format: {spec!r}")
    return FieldInterp(int(parts[0]), kind, parts[2] if kind == "date" else None)


def check_steps(n: int) -> None:
    if n < 2:
        raise ValueError(f"interpolation needs at least 2 steps, got {n}")


def _between(a: Column, b: Column, i: Column, n: int) -> Column:
    """The whole number at step i of n, cut towards zero."""
    return a + F.call_function("div", i * (b - a), F.lit(n))


def number_at(kind: str, a: Column, b: Column, i: Column, n: int) -> Column:
    if kind == "double":
        a, b = a.cast("double"), b.cast("double")
        return a + i * (b - a) / F.lit(n)
    return _between(a.cast("bigint"), b.cast("bigint"), i.cast("bigint"), n)


def time_at(a: Column, b: Column, i: Column, n: int) -> Column:
    """The instant at step i, in whole milliseconds."""
    start, end = (F.unix_millis(t.cast("timestamp")) for t in (a, b))
    return F.timestamp_millis(_between(start, end, i.cast("bigint"), n))


def _value_at(spec: Interp | FieldInterp, a: Column, b: Column, i: Column, n: int) -> Column:
    if spec.kind != "date":
        return number_at(spec.kind, a, b, i, n)
    at = time_at(a, b, i, n)
    return F.date_format(at, spec.fmt) if spec.fmt else at


def _steps(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def multiply(df: DataFrame, n: int) -> DataFrame:
    """Every record n times; none at all for n below 1."""
    if n < 1:
        return df.where(F.lit(False))
    if n == 1:
        return df
    return df.withColumn(STEP, _steps(n)).drop(STEP)


def expand_pairs(pairs: DataFrame, n: int, columns: dict[str, Column]) -> DataFrame:
    """n rows for each record that has a next one; ``columns`` may use the step."""
    stepped = pairs.where(F.col(NEXT).isNotNull()).withColumn(STEP, _steps(n))
    return stepped.withColumns(columns).drop(NEXT, STEP)


def interpolation_columns(interps: Sequence[Interp], n: int) -> dict[str, Column]:
    i = F.col(STEP)
    return {
        s.column: _value_at(s, F.col(s.column), F.col(NEXT)[s.column], i, n) for s in interps
    }


def interpolate(
    df: DataFrame,
    n: int,
    interps: Sequence[Interp],
    id_cols: Sequence[str],
    order: Sequence[str],
    *,
    rows_per_segment: int | None = None,
    total_rows: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """n records for each pair of neighbours of an id; the last of an id has no pair.

    Step 0 is the earlier record itself; columns without an interpolator keep
    its values.  Without ``id_cols`` the whole table is one chain.  ``stored``
    says that ``df`` only reads what is stored (see ``order.with_next``).
    """
    if not interps:
        raise ValueError("at least one interpolator required")
    check_steps(n)
    pairs = with_next(
        df,
        id_cols,
        order,
        [s.column for s in interps],
        rows_per_segment=rows_per_segment,
        total_rows=total_rows,
        stored=stored,
        into=NEXT,
    )
    return expand_pairs(pairs, n, interpolation_columns(interps, n))


def interpolate_with(
    df: DataFrame,
    n: int,
    kernels: dict[str, Kernel],
    id_cols: Sequence[str],
    order: Sequence[str],
    *,
    rows_per_segment: int | None = None,
    total_rows: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """A caller's own densifier: each kernel sees both records, as structs, and the step."""
    pairs = with_next(
        df,
        id_cols,
        order,
        df.columns,
        rows_per_segment=rows_per_segment,
        total_rows=total_rows,
        stored=stored,
        into=NEXT,
    )
    earlier = F.struct(*[F.col(c) for c in df.columns])
    columns = {c: k(earlier, F.col(NEXT), F.col(STEP), n) for c, k in kernels.items()}
    return expand_pairs(pairs, n, columns)


def densify(
    df: DataFrame,
    kind: int,
    n: int = 1,
    interps: Sequence[Interp] = (),
    id_cols: Sequence[str] = (),
    order: Sequence[str] = (),
    stored: bool = False,
) -> DataFrame:
    """By type code: 1 copies, 2 interpolates, 0 and every other code pass through."""
    if kind == MULTIPLY:
        return multiply(df, n)
    if kind == INTERPOLATE:
        return interpolate(df, n, interps, id_cols, order, stored=stored)
    return df


def _fields(line: Column) -> Column:
    # Trailing empty fields do not survive the split, so they are cut first.
    return F.split(F.regexp_replace(line, f"(?<=.){SEPARATOR}+$", ""), SEPARATOR)


def _value_of(fields: Column, spec: FieldInterp) -> Column:
    """A field as the number or instant its kind says, null where it is missing or unreadable."""
    text = F.get(fields, F.lit(spec.position))
    if spec.kind != "date":
        return F.trim(text).try_cast("double" if spec.kind == "double" else "bigint")
    if spec.fmt == TIMESTAMP_FORMAT:
        return strict_timestamp(text)
    return F.try_to_timestamp(text, F.lit(spec.fmt))


def _known_specs(specs: Sequence[str]) -> list[FieldInterp]:
    """Of two interpolators for one position the later one counts."""
    by_position = {s.position: s for s in map(parse_spec, specs) if s}
    return [by_position[p] for p in sorted(by_position)]


def _with_reason(lines: DataFrame, specs: Sequence[str], value: str) -> DataFrame:
    fields = _fields(F.col(value))
    reason = F.lit(None).cast("string")
    for spec in reversed(_known_specs(specs)):
        reason = F.when(_value_of(fields, spec).isNull(), f"bad field {spec.position}").otherwise(reason)
    return with_columns_once(lines, {"reason": reason})


def rejected_dense_lines(
    lines: DataFrame, specs: Sequence[str], value: str = "value"
) -> DataFrame:
    """Lines that lack a field to interpolate or cannot read it: ``value, reason``."""
    bad = _with_reason(lines, specs, value).where(F.col("reason").isNotNull())
    return bad.select(F.col(value).alias("value"), "reason")


def interpolate_lines(
    lines: DataFrame,
    n: int,
    specs: Sequence[str],
    order: Sequence[str],
    id_position: int | None = None,
    value: str = "value",
    mode: str = "strict",
    *,
    rows_per_segment: int | None = None,
    total_rows: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Text form of :func:`interpolate`: lines in, lines out, fields chosen by position.

    A line of a pair whose field is missing, or no number or date of its kind,
    fails the job.  ``permissive`` leaves such lines out beforehand, so that
    their neighbours become a pair; ``rejected_dense_lines`` returns them.
    """
    if mode not in ("permissive", "strict"):
        raise ValueError(f"unknown mode: {mode}")
    if not specs:
        raise ValueError("at least one interpolator required")
    chosen = _known_specs(specs)
    if chosen:
        check_steps(n)
    if mode == "permissive":
        good = _with_reason(lines, specs, value).where(F.col("reason").isNull())
        lines = good.select(*lines.columns)
    # Every line is parsed once; what its successor needs of it travels as values.
    fields = _fields(F.col(value))
    parsed_fields = {f"_v{k}": _value_of(fields, spec) for k, spec in enumerate(chosen)}
    id_cols: list[str] = []
    if id_position is not None and id_position >= 0:
        parsed_fields["_id"] = F.get(F.split(value, SEPARATOR), F.lit(id_position))
        id_cols = ["_id"]
    pairs = with_next(
        lines.withColumns(parsed_fields),
        id_cols,
        order,
        [f"_v{k}" for k in range(len(chosen))] or [value],
        rows_per_segment=rows_per_segment,
        total_rows=total_rows,
        stored=stored,
        into=NEXT,
    )

    def required(found: Column, spec: FieldInterp) -> Column:
        message = F.concat(F.lit(f"cannot interpolate field {spec.position} at: "), F.col(value))
        return F.coalesce(found, F.raise_error(message))

    def kept(start: int, stop: int | None) -> Column:
        """The earlier record's fields from start up to stop, null where there are none."""
        length = F.size("_first") - start if stop is None else F.lit(stop - start)
        part = F.slice("_first", F.lit(start + 1), F.greatest(length, F.lit(0)))
        return F.when(F.size(part) > 0, F.array_join(part, SEPARATOR))

    split = pairs.where(F.col(NEXT).isNotNull()).withColumn("_first", fields)
    pieces, place = {}, 0
    for k, spec in enumerate(chosen):
        pieces[f"_kept{k}"] = kept(place, spec.position)
        pieces[f"_from{k}"] = required(F.col(f"_v{k}"), spec)
        pieces[f"_to{k}"] = required(F.col(NEXT)[f"_v{k}"], spec)
        place = spec.position + 1
    pieces["_rest"] = kept(place, None)
    carried = [c for c in lines.columns if c != value]
    parsed = split.withColumns(pieces).select(*carried, *pieces)
    if n < 1:
        parsed, n = parsed.where(F.lit(False)), 1
    i = F.col(STEP)
    texts = []
    for k, spec in enumerate(chosen):
        at = _value_at(spec, F.col(f"_from{k}"), F.col(f"_to{k}"), i, n).cast("string")
        texts += [F.col(f"_kept{k}"), at]
    line = F.concat_ws(SEPARATOR, *texts, F.col("_rest"))
    return parsed.withColumn(STEP, _steps(n)).withColumn(value, line).select(*lines.columns)
