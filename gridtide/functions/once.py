"""Expressions evaluated once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``withColumns`` for costly expressions that are filtered or joined on later.

    A filter is pushed below a projection by copying its expressions, so a
    parsed field that is tested and then used would be parsed again for every
    mention.  It is not pushed below a generator: the columns are computed in
    one projection, and a generator of a single row hands them on.
    """
    aside = {name: f"_once_{name}" for name in columns}
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[F.col(a).alias(name) for name, a in aside.items()])
    computed = df.withColumns({aside[name]: c for name, c in columns.items()})
    return computed.select(*kept, F.inline(F.array(row)))
