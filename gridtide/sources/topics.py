"""Kafka topics; the connector package has to be on the cluster's class path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from gridtide.session import Endpoints

CONSUMPTIONS_TOPIC = "consumptions"
ANOMALIES_TOPIC = "anomalies"


def topic_options(
    topics: str,
    servers: str | None = None,
    records_per_trigger: int | None = None,
    extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options; ``topics`` is one name or several joined by commas."""
    options = {
        "kafka.bootstrap.servers": servers or Endpoints.from_env().kafka,
        "subscribe": ",".join(t.strip() for t in topics.split(",")),
    }
    if records_per_trigger:
        options["maxOffsetsPerTrigger"] = str(records_per_trigger)
    return {**options, **(extra or {})}


def stream_topic(spark: SparkSession, topics: str = CONSUMPTIONS_TOPIC, **kwargs) -> DataFrame:
    """The values of one or more topics as a stream of text lines."""
    reader = spark.readStream.format("kafka").options(**topic_options(topics, **kwargs))
    return reader.load().selectExpr("CAST(value AS STRING) AS value")
