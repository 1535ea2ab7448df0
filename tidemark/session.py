"""Session helpers.

Library code never creates a session; it takes the caller's.  ``local_session``
exists for tests and ``bench.py`` only.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tidemark") -> SparkSession:
    """Session for tests and local benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, set on the context once.

    ``spark.checkpoint.dir`` names it; on a cluster it must be a folder that
    all executors share, so an unset value is an error there.  A local master
    (tests) gets a scratch folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        return folder or ""
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cluster_conf(executors: int = 1000, cores_per_executor: int = 8) -> dict[str, str]:
    """Suggested settings for a large cluster (pass to ``SparkSession.builder``
    or ``spark-submit --conf``).  ``spark.checkpoint.dir`` must name a shared
    folder and is left to the deployment.

    * shuffle partitions ~ 2-3 waves of all cores; AQE coalesces small ones and
      splits skewed ones (advisory 256 MB per partition);
    * 512 MB scan splits keep the task count for 100 TB near 200k;
    * runtime broadcast of measured-small join sides up to 64 MB.
    """
    slots = executors * cores_per_executor
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.shuffle.partitions": str(3 * slots),
        "spark.sql.files.maxPartitionBytes": "512m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
