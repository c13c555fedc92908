"""Summaries over event time.  Those that group natively run as streaming aggregations with a watermark; states arrive late-data safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import sizing


def windowed_registers(stream: DataFrame, ts: str, key: str, p: int, window: str, late: str, slide: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """start, by..., idx, rank: HyperLogLog registers of tumbling or sliding windows."""
    sizing.hll_precision(p)
    rows = stream.where(F.col(key).isNotNull()).withWatermark(ts, late)
    rows = H.with_hash(rows.select(ts, *by, key), "_h", key, H.HLL_SEED)
    rank = F.least(H.leading_zeros(F.shiftleft("_h", p)) + 1, F.lit(64 - p + 1)).alias("rank")
    rows = rows.select(ts, *by, F.shiftrightunsigned("_h", 64 - p).cast("int").alias("idx"), rank)
    span: Column = F.window(ts, window, slide) if slide else F.window(ts, window)
    return rows.groupBy(span.alias("w"), *by, "idx").agg(F.max("rank").alias("rank")).select(F.col("w.start").alias("start"), *by, "idx", "rank")


def session_registers(stream: DataFrame, ts: str, key: str, p: int, gap: str, late: str, by: Sequence[str]) -> DataFrame:
    """start, end, by..., idx, rank: registers of sessions of each ``by``."""
    rows = H.with_hash(stream.where(F.col(key).isNotNull()).withWatermark(ts, late).select(ts, *by, key), "_h", key, H.HLL_SEED)
    rank = F.least(H.leading_zeros(F.shiftleft("_h", p)) + 1, F.lit(64 - p + 1))
    pairs = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.sort_array(F.collect_set(F.struct(F.shiftrightunsigned("_h", 64 - p).cast("int").alias("idx"), rank.alias("rank")))).alias("cells"))
    largest = F.filter("cells", lambda c, i: F.coalesce(F.get(F.col("cells"), i + 1)["idx"] != c["idx"], F.lit(True)))  # the last of each register
    cells = pairs.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, F.explode(largest).alias("c"))
    return cells.select("start", "end", *by, "c.idx", "c.rank")
