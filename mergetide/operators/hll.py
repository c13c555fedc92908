"""HyperLogLog: registers by a grouped maximum, cardinalities by maximum likelihood on their histogram."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import estimators, sizing
from ..functions import hashing as H
from . import dense, marks
from .relations import inclusion_exclusion


def registers(df: DataFrame, key: str, p: int, by: Sequence[str] = ()) -> DataFrame:
    """by..., idx, rank: the non-empty registers.  Null keys are skipped."""
    sizing.hll_precision(p)
    rows = H.with_hash(df.select(*by, key).where(F.col(key).isNotNull()), "_h", key, H.HLL_SEED)
    rank = F.least(H.leading_zeros(F.shiftleft("_h", p)) + 1, F.lit(64 - p + 1))
    return marks.mark(rows.groupBy(*by, F.shiftrightunsigned("_h", 64 - p).cast("int").alias("idx")).agg(F.max(rank).alias("rank")), "idx", p=p)


def merge(*states: DataFrame) -> DataFrame:
    """Register-wise maximum of states of one precision."""
    out = marks.union(states, "idx")
    return out.groupBy(*[c for c in out.columns if c != "rank"]).agg(F.max("rank").alias("rank"))


def rollup(state: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of all prefixes of ``by``, from the finest states alone."""
    by = list(by)
    sets = [[F.col(c) for c in [*by[:i], "idx"]] for i in range(len(by), -1, -1)]
    return _over(state, sets, by)


def cube(state: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of all subsets of ``by``, from the finest states alone; null stands for what a row sums up."""
    return grouping_sets(state, [[c for j, c in enumerate(by) if i >> j & 1] for i in range(1 << len(by))], by)


def grouping_sets(state: DataFrame, sets: Sequence[Sequence[str]], by: Sequence[str]) -> DataFrame:
    """States of the given subsets of ``by``."""
    return _over(state, [[F.col(c) for c in [*s, "idx"]] for s in sets], by)


def _over(state: DataFrame, sets: list, by: Sequence[str]) -> DataFrame:
    out = state.groupingSets(sets, *by, "idx").agg(F.max("rank").alias("rank"))
    mark = marks.read(state, "idx")
    return marks.mark(out, "idx", **mark) if mark else out


def estimate(state: DataFrame, p: int, by: Sequence[str] = ()) -> DataFrame:
    """by..., estimate: groups without registers do not appear, but one row does if ``by`` is empty."""
    q = 64 - sizing.hll_precision(p)
    marks.check(state, "idx", p=p)
    histogram = state.groupBy(*by, "rank").agg(F.count(F.lit(1)).alias("n"))
    entries = histogram.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "n"))).alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("used"))

    @F.pandas_udf("double")
    def solve(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: estimators.hll([int(x) for x in c])).astype(float)

    counts = F.concat(F.array(F.lit(1 << p) - F.col("used")), F.transform(F.sequence(F.lit(1), F.lit(q + 1)), lambda r: F.coalesce(F.col("m")[r], F.lit(0).cast("long"))))
    return entries.select(*by, solve(counts).alias("estimate"))


def rounded(estimate):
    """A count from an estimate: half up, the largest long for infinity."""
    return F.when(estimate < 9.2e18, F.round(estimate).cast("long")).otherwise(F.lit((1 << 63) - 1))


def count_distinct(df: DataFrame, key: str, p: int, by: Sequence[str] = ()) -> DataFrame:
    """by..., count."""
    return estimate(registers(df, key, p, by), p, by).withColumn("count", rounded(F.col("estimate"))).drop("estimate")


def relate(left: DataFrame, right: DataFrame, p: int) -> DataFrame:
    """left, right, union, intersection, jaccard: one row, for two states without group columns."""
    tagged = left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right"))).unionByName(merge(left, right).withColumn("side", F.lit("union")))
    got = estimate(tagged, p, ["side"]).groupBy().agg(*(F.coalesce(F.max(F.when(F.col("side") == s, F.col("estimate"))), F.lit(0.0)).alias(s) for s in ("left", "right", "union")))
    return got.select("*", inclusion_exclusion(F.col("left"), F.col("right"), F.col("union")).alias("x")).select("left", "right", "union", "x.*")


def compact(state: DataFrame, p: int, by: Sequence[str] = ()) -> DataFrame:
    """by..., p, registers: one binary of ``2**p`` bytes for each group."""
    marks.check(state, "idx", p=p)
    return dense.as_binary(state, by, "idx", "rank", 1 << p, "registers").select(*by, F.lit(p).alias("p"), "registers")


def expand(compact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., idx, rank."""
    return dense.from_binary(compact, by, "registers", "idx", "rank")
