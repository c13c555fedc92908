"""Exact quantiles behind a summary: its answers cut the values of a group into runs, and a run's count tells which ranks it holds.

All rows are counted by run, then those of the runs that hold a rank asked for are taken by value.  The cuts decide how
much is sorted, never what comes out: a summary that is far off costs time only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import small, stage


def around(queries: Sequence[float], error: float) -> list[float]:
    """What to ask a summary of this rank error, so that its answers lie on both sides of those to ``queries``."""
    return sorted({min(1.0, max(0.0, q + e)) for q in queries for e in (-error, error)})


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """On equal keys; nulls equal each other."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(right, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys), F.lit(True)), how).drop(*(f"_r_{k}" for k in keys))


def exact(df: DataFrame, value: str, answers: DataFrame, queries: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by..., q, value: at the zero-based rank ``min(floor(q * N), N - 1)`` of all values but nulls, in ascending order with NaN last.

    ``answers``: by..., value, from a summary of the same rows.  A task sorts the distinct values of one run of one group.
    """
    by, runs = list(by), [*by, "_run"]
    cuts = stage(answers.where("value is not null").groupBy(*by).agg(F.array_sort(F.collect_set("value")).alias("_cuts")), "cuts")
    rows = _join(df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null"), small(cuts), by, "left")
    rows = rows.select(*by, "_v", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= F.col("_v"))).alias("_run"))
    whole = Window.partitionBy(*by)
    counts = rows.groupBy(*runs).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_total": F.sum("_n").over(whole), "_upto": F.sum("_n").over(whole.orderBy("_run"))})
    asked = counts.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in queries]).cast("array<double>")))
    asked = asked.withColumn("_rank", F.least(F.floor(F.col("q") * F.col("_total")), F.col("_total") - 1) - F.col("_upto") + F.col("_n"))
    asked = small(stage(asked.where("_rank >= 0 and _rank < _n").select(*runs, "q", "_rank"), "ranks"))
    # grouping makes -0.0 a 0.0, so the two are told apart by their text
    taken = _join(rows, asked.select(*runs), runs, "leftsemi").withColumn("_zero", F.when(F.col("_v") == 0, F.col("_v").cast("string")))
    taken = taken.groupBy(*runs, "_v", "_zero").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(Window.partitionBy(*runs).orderBy("_v", "_zero")))
    found = _join(taken, asked, runs).where("_rank < _upto and _rank >= _upto - _n")
    return found.select(*by, "q", F.coalesce(F.col("_zero").cast("double"), "_v").alias("value"))
