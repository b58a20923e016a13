"""Time the registered queries of the library and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of cores.
Every query but those of ``LEFT_OUT`` runs twice into a sink that takes all rows and stores none; the
second time counts, from building the plan to the last row.  Detection is also
timed against a model that is there already (``detect_ready``).  The text
operators have a check of their own and are left out.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from gridtide.operators.detect import detect
from gridtide.operators.model import with_hour_key
from gridtide.plans import QUERIES
from gridtide.plans.queries import _model
from gridtide.session import get_session, scratch_folder
from gridtide.sinks import save_model
from gridtide.sources import tables
from gridtide.streaming.detect import model_for

# The same work as stream_interpolate in five times as many batches.
LEFT_OUT = {"stream_interpolate_log"}
# Records these queries put out per record of ``events``, for the rate in records per second.
RECORDS_OUT = {"densify_multiply": 8, "densify_interpolate": 4, "densify_lines": 4, "detect_ready": 1}


def detect_ready(spark: SparkSession, sf_dir: str, stored: str) -> DataFrame:
    """Detection alone: the readings against a stored model, by their dates."""
    readings = with_hour_key(tables.events(spark, sf_dir))
    return detect(readings, model_for(readings, spark.read.parquet(stored)))


def timed(build) -> float:
    for _ in range(2):
        begin = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "gridtide-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {name: timed(lambda: query(spark, sf_dir)) for name, query in QUERIES.items() if name not in LEFT_OUT}  # noqa: B023
    stored = save_model(_model(spark, sf_dir), scratch_folder(spark, "model"))
    seconds["detect_ready"] = timed(lambda: detect_ready(spark, sf_dir, stored))
    rates = {n: round(events * k / seconds[n]) for n, k in RECORDS_OUT.items()}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "records_per_second": rates,
            }
        )
    )


if __name__ == "__main__":
    main()
