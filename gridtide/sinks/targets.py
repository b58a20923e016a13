"""File and topic targets for batch and streaming writers."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from gridtide.session import Endpoints
from gridtide.sources.topics import ANOMALIES_TOPIC


@dataclass(frozen=True)
class Target:
    format: str
    options: Mapping[str, str] = field(default_factory=dict)

    @property
    def path(self) -> str | None:
        return self.options.get("path")


def file_target(path: str, format: str = "parquet", **options: str) -> Target:
    """Files below ``path``; ``options`` go to the writer, of batches and of streams alike."""
    return Target(format, {"path": path, **options})


def topic_target(
    topic: str = ANOMALIES_TOPIC,
    servers: str | None = None,
    extra: Mapping[str, str] | None = None,
) -> Target:
    """Records ``key, value`` to a topic; ``extra`` passes producer settings on."""
    servers = servers or Endpoints.from_env().kafka
    return Target("kafka", {"kafka.bootstrap.servers": servers, "topic": topic, **(extra or {})})


def write_batch(df: DataFrame, target: Target, batch_id: int | None = None) -> None:
    """Write one batch.  A file target gets a folder per batch, replaced on a rerun:
    each batch is there exactly once.  A topic may see a batch again after a failure.
    """
    writer = df.write.format(target.format)
    if target.path is None:
        writer.options(**target.options).save()
        return
    path = target.path if batch_id is None else f"{target.path}/batch={batch_id}"
    options = {k: v for k, v in target.options.items() if k != "path"}
    writer.options(**options).mode("overwrite").save(path)
