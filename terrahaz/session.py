"""Session settings the jobs are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "terrahaz", cores: str = "8", shuffle_partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """Local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # few, small partitions: merging them would leave cores idle
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def joins_by_measure(spark: SparkSession) -> SparkSession:
    """Let adaptive execution alone choose broadcasts, by the measured size of a side.

    Estimates made before a run take a side for as small as its compressed files,
    whatever ``explode`` makes of it, and build it on the driver.  The session's own
    threshold stays the bound; explicit broadcasts stay as well.
    """
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if spark.conf.get("spark.sql.adaptive.enabled") == "true" and not bound.startswith("-"):
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", bound)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Only in a session on one machine (tests, a laptop) may that setting be
    absent; a temporary folder is used then.  On a cluster it is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        jvm_uuid = spark._jvm.java.util.UUID.randomUUID().toString()
        return f"{base.rstrip('/')}/{purpose}-{jvm_uuid}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="terrahaz-"), purpose)
