"""The expected-consumption model kept up to date from stored partial sums.

Sums per ``(id, date, hour)`` are stored by date, a folder for each addition.
New readings add sums for their own dates; what they change in the model are
the dates that look at those.  Only these dates are computed again, from stored
sums, and only their folders are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.functions.weather import OFFSET
from gridtide.operators.model import KEY, MODES, adjusted_partials, expected_of, reading_unit, shift_partials


def target_lags(lags: Sequence[int], mode: str) -> list[int]:
    """By how many days the readings of a date move to the dates whose expectation they feed."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if not lags:
        raise ValueError("at least one lag required")
    if mode == "literal":
        return [-1]
    return sorted({-lag if mode == "minus_days" else lag for lag in lags})


class ModelStore:
    """A model in ``folder``, and the sums it is made of.

    The options are those of ``build_expected_model`` and must stay the same for
    all additions, as must the type of the readings.
    """

    def __init__(
        self,
        folder: str,
        lags: Sequence[int] = (1, 2, 3),
        mode: str = "trailing",
        offset: int = OFFSET,
        missing_weather: str = "neutral",
    ) -> None:
        self.moves = target_lags(lags, mode)
        self.lags, self.mode, self.offset, self.missing_weather = list(lags), mode, offset, missing_weather
        self.sums, self.path = f"{folder.rstrip('/')}/sums", f"{folder.rstrip('/')}/model"

    def add(self, readings: DataFrame, weather: DataFrame, addition: str) -> str:
        """Add readings, and bring the model up to date; returns the model's path.

        ``addition`` names what is added: the same name again replaces what it
        added to the same dates, so that a failed addition can be repeated.
        Readings of a date may come in any number of additions.  Weather is
        looked up for the new readings only.
        """
        spark = readings.sparkSession
        partials = adjusted_partials(readings, weather, self.offset, self.missing_weather)
        placed = partials.withColumn("addition", F.lit(addition)).hint("rebalance", "date")
        self._replace(placed, self.sums, "date", "addition")
        stored = self._stored(spark, partials.schema)
        touched = stored.where(F.col("addition") == addition).select("date").distinct()
        targets = touched.select(F.explode(self._moved("date", 1)).alias("target")).distinct()
        # The stored dates that the targets look at; Spark opens no other folders of the sums.
        sources = targets.select(F.explode(self._moved("target", -1)).alias("date")).distinct()
        needed = stored.join(F.broadcast(sources), "date", "left_semi")
        # A date may have sums of several additions.
        whole = needed.groupBy(*KEY).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        shifted = shift_partials(whole, self.lags, self.mode)
        changed = shifted.join(F.broadcast(targets), shifted["date"] == targets["target"], "left_semi")
        model = expected_of(changed, reading_unit(readings))
        self._replace(model.hint("rebalance", "date"), self.path, "date")
        return self.path

    def model(self, spark: SparkSession) -> DataFrame:
        """``id, date, hour, expected, n`` as it is now."""
        return spark.read.parquet(self.path).select(*KEY, "expected", "n")

    def _moved(self, date: str, sign: int):
        return F.array(*[F.date_add(F.col(date), sign * move) for move in self.moves])

    def _stored(self, spark: SparkSession, sums: T.StructType) -> DataFrame:
        kinds = [T.StructField("date", T.DateType()), T.StructField("addition", T.StringType())]
        plain = [f for f in sums.fields if f.name != "date"]
        return spark.read.schema(T.StructType([*plain, *kinds])).parquet(self.sums)

    @staticmethod
    def _replace(df: DataFrame, path: str, *by: str) -> None:
        """Write these partitions, and leave all others as they are."""
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).parquet(path)
