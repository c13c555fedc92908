"""Shared pieces: table loading, slices of batches, and connected components on staged tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staged import BROADCAST_ROWS, discard, new_path, remove, small, stage  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(source: Column) -> Column:
    """A non-null string that tells all values apart, null included."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short slices of batches, which may hold many long texts, so that few are in Python's memory at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph, by alternating large-star and small-star steps.

    ``edges``: columns ``a``, ``b`` (long); loops, repeats and both directions are allowed.  Returns one row
    (``node``, ``comp``) for each node that has an edge to another; ``comp`` is the smallest node of its
    component, itself included.  Each step is a grouped minimum (combined before the shuffle) and a join
    of two tables; neighbour lists are never gathered.  An empty table gives an empty table.
    """
    u, v = F.col("u"), F.col("v")
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        if not e.groupBy("u").count().where("count > 1").limit(1).count() and not e.join(e.select(u.alias("v")), "v", "left_semi").limit(1).count():
            return e.select(u.alias("node"), v.alias("comp")).union(e.select(v.alias("node"), v.alias("comp")).distinct())
        both = e.union(e.select(v.alias("u"), u.alias("v")))
        # staged, so that the join is one of two plain exchanges, of which adaptive execution splits the hubs, or a broadcast
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = stage(both.join(small(low), "u").where("v > u").select(v.alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        step = large.join(small(least), "u").where("v <> m").select(v.alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, e = e, stage(step.distinct(), "edges")
        discard(before, large, low, least)
