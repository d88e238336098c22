"""Spark session helpers.

The library never creates a session on a cluster; it only reads settings from
the one it is given. ``local_session`` is for tests, the bench and the smoke
entry point.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for local runs: UI off, AQE on, UTC, Arrow on."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("codelens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    # local runs only: a scratch checkpoint folder (a cluster names a shared one)
    builder = builder.config("spark.checkpoint.dir", _scratch("codelens-ckpt-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` is set by the deployment and is a
    shared file system; it is only filled in here when unset (local tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            # a machine-local folder would not survive a lost executor on a cluster
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        # unset in a local run (tests, bench): a scratch folder
        conf_dir = _scratch("codelens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def _scratch(prefix: str) -> str:
    return tempfile.mkdtemp(prefix=prefix, dir=os.environ.get("CODELENS_SCRATCH", "/tmp"))
