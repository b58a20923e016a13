"""Storing the expected-consumption model."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from gridtide.operators.model import model_lines


def publish_model(model: DataFrame, folder: str, run_ms: int | None = None) -> str:
    """Write the model as text lines to a new folder named by the run's time; returns it."""
    run_ms = int(time.time() * 1000) if run_ms is None else run_ms
    path = f"{folder.rstrip('/')}/{run_ms}"
    model_lines(model).write.text(path)
    return path


def save_model(model: DataFrame, path: str) -> str:
    """Write the model as parquet, one folder per date, so that a job reads only its dates.

    The rebalance hint gathers a date's rows and lets Spark split large dates
    and merge small ones by size.
    """
    placed = model.hint("rebalance", "date")
    placed.write.mode("overwrite").partitionBy("date").parquet(path)
    return path
