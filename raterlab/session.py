"""SparkSession helpers.

Cluster settings (shuffle partitions, checkpoint dir, memory) belong to the
cluster; we only fill in defaults that are *unset*, which is what happens in
tests and local benchmarks.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows here are CPU-heavy (text search, nested arrays) while shuffles are small in
    # bytes; let AQE keep more, smaller partitions than its 1 MB default floor
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "raterlab") -> SparkSession:
    """Session for tests and local benchmarks (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("RATERLAB_DRIVER_MEM", "8g")))
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points to shared storage and is used as is. Only
    when it is unset (tests, a laptop) a fresh scratch folder is created.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "local")
    if not d and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="raterlab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 — remote sessions take the conf value
        pass
    return d


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def read_if_exists(read: Callable[[], DataFrame]) -> DataFrame | None:
    """``read()``, or None when its path does not exist; every other error is raised, so a
    table that is there but unreadable is never taken for an absent one."""
    try:
        return read()
    except AnalysisException as ex:
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
