"""Date parts and the ``id-year-dayOfYear-hour`` key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: between the parts of a key.
SEPARATOR = "-"


def date_parts(ts: Column) -> dict[str, Column]:
    """Year, day of year and hour of a timestamp column, by name."""
    return {"year": F.year(ts), "day_of_year": F.dayofyear(ts), "hour": F.hour(ts)}


def epoch_millis(ts: Column) -> Column:
    """Whole milliseconds since the epoch (floor, as ``unix_millis`` does)."""
    return F.unix_millis(ts.cast("timestamp"))


def composite_key(id_: Column, date: Column, hour: Column) -> Column:
    return F.concat_ws(SEPARATOR, id_, F.year(date), F.dayofyear(date), hour)


def key_columns(key: Column) -> dict[str, Column]:
    """``id, date, hour`` of a key text, null where a part cannot be read."""
    # Counted from the end: the id may start with a minus sign.
    tail = F.substring_index(key, SEPARATOR, -3)
    id_ = F.left(key, F.length(key) - F.length(tail) - 1)
    new_year = F.concat(F.substring_index(tail, SEPARATOR, 1), F.lit("-01-01")).try_cast("date")
    day = F.split_part(tail, F.lit(SEPARATOR), F.lit(2)).try_cast("int")
    return {
        "id": id_.try_cast("bigint"),
        "date": F.date_add(new_year, F.when(day.between(1, 366), day - 1)),
        "hour": F.substring_index(tail, SEPARATOR, -1).try_cast("int"),
    }
