"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE does the run-time work: it merges small shuffle partitions, turns a sort-merge join
# into a broadcast join once a side is known to be small, and splits skewed partitions, so
# one customer or product holding much of the fact does not end up in one task.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # The size check of broadcasts: joins carry no hint, so a dimension is broadcast only
    # while its pruned size stays below this. (The rollup counts rows and then decides.)
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # Files are compressed: count a scan as the size it unpacks to, so that the threshold
    # bounds what is held in memory.
    "spark.sql.sources.fileCompressionFactor": "3.0",
}


# The greatest number of reduce tasks a job is planned with, and the bytes one is to take.
MOST_PARTITIONS = 40_000
PARTITION_BYTES = 256 * 1024 * 1024


def shuffle_partitions_for(shuffled_bytes: int, cores: int = 200) -> int:
    """Reduce tasks for a shuffle of this size.

    AQE merges partitions that turn out small but does not split a large one outside of
    joins, so a job over much data has to start with many: 10 TB shuffled need the 40,000.
    """
    wanted = -(-shuffled_bytes // PARTITION_BYTES)
    return max(min(wanted, MOST_PARTITIONS), cores)


def build_session(
    app: str = "orderlens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """A session with the settings above; `extra` keys use `__` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def runs_in_one_process(master: str) -> bool:
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where `spark.checkpoint.dir` is unset and everything runs in one process, as in local
    tests, a temporary folder is made and recorded in the session. On a cluster each executor
    would write to its own disk, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not runs_in_one_process(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="orderlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/orderlens/{label}-{uuid.uuid4().hex}"
