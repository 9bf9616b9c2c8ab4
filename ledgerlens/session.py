"""Spark session settings the engine relies on.

The engine never owns the cluster's session: ``configure`` only sets the
runtime SQL options whose values change results (time zone) and leaves
everything else - shuffle partitions, broadcast threshold, checkpoint dir -
to whoever built the session. ``local_session`` is the builder used by
tests and the benchmark.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_HELD: dict[str, tuple[int, str | None]] = {}
_HELD_LOCK = threading.Lock()


def configure(spark: SparkSession) -> SparkSession:
    """Runtime options that results depend on; safe to call repeatedly."""
    # Month boundaries and day counts are computed on wall-clock time.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # lineage cuts (checkpoint) need the shared folder; a local session gets its own
    ensure_checkpoint_dir(spark)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "ledgerlens") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for lineage cuts and snapshots."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's checkpoint dir; only a local (test) session gets its own."""
    d = checkpoint_dir(spark)
    if d is None:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a cluster run needs a shared folder")
        d = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def shared_root(spark: SparkSession) -> str:
    """The shared folder itself (``spark.checkpoint.dir``), for data that should
    outlive one application, such as snapshots. Falls back to the context's
    checkpoint dir (set by ``ensure_checkpoint_dir`` in local runs)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = ensure_checkpoint_dir(spark)
    return root.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver next collects garbage: steps
    that follow one another need the disk of the largest only. The session's own setting is back
    when the last thread has left."""
    session = spark._jsparkSession.sessionUUID()
    with _HELD_LOCK:
        depth, before = _HELD.get(session) or (0, spark.conf.get(FREE_SHUFFLES, None))
        _HELD[session] = (depth + 1, before)
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _HELD_LOCK:
            depth, before = _HELD.pop(session)
            if depth > 1:
                _HELD[session] = (depth - 1, before)
            elif before is None:
                spark.conf.unset(FREE_SHUFFLES)
            else:
                spark.conf.set(FREE_SHUFFLES, before)


def scratch_dir(spark: SparkSession, kind: str) -> str:
    """A new folder name under the shared folder, removed when the application ends."""
    path = f"{shared_root(spark)}/ledgerlens-{kind}/{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)  # only an existing path can be marked
    fs.deleteOnExit(hadoop_path)
    return path
