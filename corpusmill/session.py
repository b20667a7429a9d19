"""Session set-up and the shared folder in which intermediate tables are written."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def local_session(app: str = "corpusmill", cpus: int | str = "*", shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and the bench; on a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = configured.get() if configured.isDefined() else None
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df; nothing that still reads it may run later."""
    remove(df.sparkSession, df._written_at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            remove(spark, path)


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size (for a scan: bytes of its files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, bytes_each: int = 4 << 20) -> int:
    """How many hash buckets split df so that each stays near bytes_each on disk; never fewer than the shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, math.ceil(size_in_bytes(df) / bytes_each)))


def text_buckets(df: DataFrame, text_col: str, bytes_each: int) -> int:
    """How many hash buckets split df so that each has about bytes_each of (uncompressed) text; never fewer than the shuffle partitions."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bytes_each))
