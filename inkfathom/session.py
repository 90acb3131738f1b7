"""Session helpers: table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its files are no larger than this many bytes.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``; only a session without that setting (tests, a
    laptop) gets a folder of its own, and only when it runs in local mode.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="inkfathom-checkpoint-")
    sc.setCheckpointDir(known)
    return known


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so later steps neither recompute it nor need its executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files, and checkpoints if the session has them cleaned, that nothing refers to
    any more; else they lie on disk until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def data_bytes(path: str) -> int | None:
    """Bytes of a local table, None where the path cannot be measured from the driver."""
    path = path.removeprefix("file://")
    if not os.path.exists(path):
        return None
    if os.path.isfile(path):
        return os.path.getsize(path)
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a DataFrame; a Parquet scan's estimate comes from its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the planner's size estimate is within ``limit``, else ``df`` as it is.

    Beyond the limit Catalyst falls back to a shuffled join, with AQE's skew handling.
    """
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def counted_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, whose lineage is cut, with a broadcast hint if its rows, counted, are within ``limit``, else ``df`` as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
