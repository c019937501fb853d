"""Session helpers: settings, shared work folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str = "8", app: str = "docmill") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's shared folder.

    The shared folder is the session's ``spark.checkpoint.dir``. Only a local
    session without that setting falls back to a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = os.path.join(tempfile.gettempdir(), "docmill-work")
    path = f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


def clean_work_dirs(spark: SparkSession) -> None:
    """Delete the work folders that this process has named so far. Tables read from
    them, and DataFrames that rest on those, can't be used any more."""
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> bool:
    """Whether a table may be broadcast; reads at most ``max_rows + 1`` rows of it."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    rows, size = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0)))
        .first()
    )
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(
    df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20
) -> DataFrame:
    """Mark ``df`` for broadcast only after measuring that it is small.

    A larger table comes back unmarked, and the join then shuffles both sides
    (adaptive execution splits its skewed partitions).
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
