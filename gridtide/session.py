"""Session settings, service addresses and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

SESSION_SETTINGS = {
    # Date parts and rendered timestamps must not depend on the host's zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # What is kept between steps is merged as well: a micro-batch is a few partitions, not one a shuffle's.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    # Where every partition of one side is this small, hash it instead of sorting both sides.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Ranges stored in order (operators/order.py): a bucket of one file is read as sorted, and rows
    # that lie together by some of their keys may be joined by all of them where they lie.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


#: What Python workers are handed at once: a few chunks of text, not ten thousand rows of whatever length.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

#: Bytes of input that one shuffle partition should stand for, and the widths between which that holds.
SHUFFLE_BYTES = 128 << 20
SHUFFLE_WIDTHS = (200, 200_000)


def get_session(
    app: str = "gridtide", master: str | None = None, input_bytes: int | None = None, **extra: str
) -> SparkSession:
    """A session with the library's settings; ``extra`` overrides them.

    With ``input_bytes`` shuffles start as wide as that much input needs, and
    adaptive execution merges what turns out small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(SESSION_SETTINGS)
    if input_bytes is not None:
        least, most = SHUFFLE_WIDTHS
        width = min(most, max(least, -(-input_bytes // SHUFFLE_BYTES)))
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(width)
    for key, value in {**settings, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pinned_session(spark: SparkSession, settings: Mapping[str, str] = SESSION_SETTINGS) -> SparkSession:
    """``spark`` if it has the library's ``settings``, else a session beside it that has them.

    The other session shares the context and copies the settings of ``spark``;
    ``spark`` itself is not changed.
    """
    if all(spark.conf.get(k, None) == v for k, v in settings.items()):
        return spark
    beside = spark.newSession()
    for key, value in {**spark.conf.getAll, **settings}.items():
        if beside.conf.isModifiable(key):
            beside.conf.set(key, value)
    return beside


@dataclass(frozen=True)
class Endpoints:
    """Service addresses, read from the environment with local defaults."""

    kafka: str = "localhost:9092"
    hdfs: str = "hdfs://localhost:9000"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Endpoints:
        env = os.environ if env is None else env
        hdfs = env.get("HDFS_IP_PORT")
        return cls(
            kafka=env.get("KAFKA_IP_PORT", cls.kafka),
            hdfs=f"hdfs://{hdfs}" if hdfs else cls.hdfs,
        )


_local_folders: dict[str, str] = {}


def _local_folder(application: str) -> str:
    """A folder of this process for one application, removed when the process ends."""
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="gridtide-")
        atexit.register(shutil.rmtree, _local_folders[application], ignore_errors=True)
    return _local_folders[application]


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would not be visible to the executors.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_folder(sc.applicationId)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
