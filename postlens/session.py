"""Session construction and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
ARROW_BATCH_BYTES = 64 << 20


def session_builder(master: str | None = None, shuffle_partitions: int | None = None,
                    app_name: str = "postlens", extra: dict | None = None,
                    enable_hive: bool = False) -> SparkSession.Builder:
    """The builder behind ``build_session`` (settings only, no session yet).

    ``master`` and ``shuffle_partitions`` are set only when given (tests,
    bench): on a cluster the master comes from ``spark-submit`` and the
    partition count from the cluster's configuration, with AQE coalescing
    small shuffle partitions and splitting skewed ones at run time.
    ``enable_hive`` registers stream tables in a Hive metastore instead of the
    in-memory catalog (only one process may hold an embedded store).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Arrow batches to pandas UDFs close at 64 MiB as well as at the record
        # count: 10,000 whole texts could otherwise make one batch of gigabytes.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
        # checkpoint files (row index) are removed once their frame is garbage
        # collected, instead of accumulating in the shared checkpoint folder
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    if enable_hive:
        builder = builder.enableHiveSupport()
    return builder


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "postlens", extra: dict | None = None,
                  enable_hive: bool = False) -> SparkSession:
    """A session with the settings the library assumes: AQE on, UTC, no UI
    (see ``session_builder``)."""
    spark = session_builder(master, shuffle_partitions, app_name, extra, enable_hive).getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:
        pass
    return spark


_BYTE_UNITS = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
               "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def _parse_bytes(text: str) -> int:
    t = text.strip().lower()
    digits = t.rstrip("abcdefghijklmnopqrstuvwxyz")
    return int(digits) * _BYTE_UNITS.get(t[len(digits):] or "b", 1)


def max_partition_bytes(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes`` in bytes (default 128 MiB)."""
    return _parse_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))


def default_parallelism(spark: SparkSession) -> int:
    """Task slots of the session (classic sessions; 1 when unknown)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # e.g. a Spark Connect session has no SparkContext
        return int(spark.conf.get("spark.default.parallelism", "1"))


def estimated_bytes(df) -> int | None:
    """Catalyst's size estimate of a plan (file sizes for a scan); no job runs.

    ``None`` when the session does not expose it (e.g. Spark Connect).
    """
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Read from the session. A session with a local master that names none (a
    test) gets a fresh local folder; on a cluster a missing setting is an
    error, as a local folder of one machine would not be seen by the others.
    """
    root = spark.conf.get(_CHECKPOINT_CONF, None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint directory
        if root:
            return root.rstrip("/")
        raise RuntimeError(f"{_CHECKPOINT_CONF} is not set on this session")
    if root:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(root)
        return root.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="postlens-ckpt-")
    sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/postlens/{name}-{uuid.uuid4().hex}"
