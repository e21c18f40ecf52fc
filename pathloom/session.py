"""Session helpers: the shared checkpoint folder, durable cuts and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when counted at or under this many rows and this many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pathloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        # plans are built from many small expressions, and a stack trace for each would take most of a short search
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session that names none gets a temporary one: executors of a cluster couldn't read each other's."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pathloom-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a path of the file system, beside the checkpoints that all executors share."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.removeprefix('file://').removeprefix('file:').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(df: DataFrame) -> Column:
    """About what a row takes in a broadcast: its texts and lists by length, everything else eight bytes."""
    size = F.lit(16)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        long = F.octet_length(c) if kind in ("string", "binary") else F.size(c) * (64 if "string" in kind or "struct" in kind else 8) if kind.startswith("array") else F.lit(0)
        size = size + 8 + F.coalesce(F.greatest(long, F.lit(0)), F.lit(0))
    return size


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether at most so many rows of at most so many bytes; counting ends one row beyond."""
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast after counting rows and bytes; otherwise leave a shuffle join."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
