"""Staged tables: written as Parquet below ``spark.checkpoint.dir`` and read back.

That cuts the lineage, survives lost executors, makes what several branches of a plan need only once, and lets adaptive
execution see two plain exchanges below a join, so that it can split a hot key.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; above it the join shuffles.
BROADCAST_ROWS = 100_000
_made: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  A temporary one serves only a local session without the setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mergetide-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/mergetide/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have ended before
            remove(spark, path)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing needs any more."""
    for df in tables:
        remove(df.sparkSession, df.staged_at)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """Mark a staged table for broadcast if it has at most ``rows`` rows; else leave the join to shuffle.

    ``weight``: what a row counts for, if it may be long.
    """
    n = df.limit(rows + 1).count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= rows else df
