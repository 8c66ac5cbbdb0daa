"""Session helpers: the engine takes the caller's SparkSession.

Only tests and the bench build their own session (``local_session``). Library
code reads configuration from the session it is given and never sets cluster
settings itself.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The reliable checkpoint folder the cluster names, if any.

    SparkContext picks up ``spark.checkpoint.dir`` at start-up; a folder set
    later with ``setCheckpointDir`` is honoured as well.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    return None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Set ``fallback`` as checkpoint folder only where the session has none (tests)."""
    current = checkpoint_dir(spark)
    if current:
        return current
    spark.sparkContext.setCheckpointDir(fallback)
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder (shared storage).

    Without one, a local-mode session (one machine: driver and executors
    share its disk) gets a fresh temporary folder; any other session raises,
    since a machine-local folder is not visible to other executors.
    """
    base = checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("no checkpoint folder: set spark.checkpoint.dir to a shared path")
        base = tempfile.mkdtemp(prefix="trolley-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder written under ``shared_path`` (any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, reliable: bool = True) -> DataFrame:
    """Compute ``df`` once and keep it for reuse.

    With a checkpoint folder configured the result is written there and its
    lineage cut, so losing an executor later never re-runs the work behind it.
    The data is also kept in memory/disk so that the checkpoint write and later
    reads do not recompute it.
    """
    spark = df.sparkSession
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if reliable and checkpoint_dir(spark):
        # The checkpoint job reads ``kept`` instead of recomputing ``df``.
        written = kept.checkpoint(eager=True)
        kept.unpersist(blocking=False)
        return written.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench (never used by library code)."""
    parts = shuffle_partitions or cores
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trolley")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
