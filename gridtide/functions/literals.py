"""Small frames from values at hand."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def few_rows(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str) -> DataFrame:
    """A frame of one partition with a few rows, made of literals: no Python worker is started for it."""
    fields = T.StructType.fromDDL(schema).fields
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)])
        for row in rows
    ]
    listed = F.array(*structs) if structs else F.array().cast(T.ArrayType(T.StructType(fields)))
    return spark.range(0, 1, 1, 1).select(F.inline(listed))
