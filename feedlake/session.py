"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "feedlake") -> SparkSession:
    """Session for tests and the local bench.  On a cluster, build your own session;
    every operator only needs ``spark.sql.session.timeZone=UTC`` for exact date logic."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FEEDLAKE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is used as is.  Only when it
    is unset (local tests) do we create a folder of our own and register it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder shared by all executors (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="feedlake-ckpt-", dir=os.environ.get("FEEDLAKE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context: functions that run in tasks
    are pickled by reference, and a worker need not find the package on its own path."""
    sc = spark.sparkContext
    if getattr(sc, "_feedlake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="feedlake-"), "feedlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.join("feedlake", os.path.relpath(file, root)))
    sc.addPyFile(path)
    sc._feedlake_shipped = True


#: Spark's own bound is 64 MB.  An executor holds a batch, and its buffers while they grow, outside the heap, once for
#: every task and Python worker, and keeps what was once allocated there; buffers of this size are pooled and used again.
BATCH_BYTES = 3 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let no batch of rows that a Python worker gets be larger than ``BATCH_BYTES``, unless a single row is; a smaller
    bound of the session stays.  No result depends on where batches end."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key, "64m").lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "": 1}
    number = size.rstrip("bkmg")
    if not number.isdigit() or int(number) * units.get(size[len(number) :], 1) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/feedlake-{name}-{uuid.uuid4().hex[:12]}"


def written_once(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again, for rows that several jobs use: each
    then reads the columns it needs and repeats none of the work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
