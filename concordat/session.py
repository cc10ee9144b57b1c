"""Session settings and the shared folder used for state that must outlive a task."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime re-planning picks broadcast joins from measured sizes and splits the
# partitions of hot join keys, so no operator carries a broadcast hint.  Where the
# measured partitions of a directory are small, it also hashes them instead of
# sorting both sides.
ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
}

# For streams with state for many tasks: keeps it on disk instead of in the heap.
STREAMING_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(name: str = "concordat", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names it.  Only a session without one, as in tests
    on one machine, gets a new temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="concordat-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
