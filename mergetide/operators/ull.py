"""UltraLogLog: the OR of observation bits of each register, packed into one byte, at precisions that may differ."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require, same
from ..functions import estimators, sizing
from ..functions import hashing as H
from .hll import rounded
from . import dense
from .relations import inclusion_exclusion

ESTIMATORS = {"fgra": estimators.ull_fgra, "mle": estimators.ull_mle}


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def pack(prefix: Column) -> Column:
    """The byte of a prefix: its top bit and the two below it."""
    zeros = H.leading_zeros(prefix) + 1
    recent = F.call_function("shiftrightunsigned", F.when(zeros < 64, F.call_function("shiftleft", prefix, zeros)).otherwise(F.lit(0).cast("long")), F.lit(62))
    return F.when(prefix == 0, F.lit(0)).otherwise((F.pmod(-4 * zeros, F.lit(256)) + recent).cast("int"))


def unpack(register: Column) -> Column:
    """The prefix bits that a byte keeps."""
    pattern = (register % 4 + 4).cast("long")
    return F.when(register < 8, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", pattern, (F.shiftright(register, 2) - 2).cast("int")))


def raw_registers(df: DataFrame, hash_: str, p: int, by: Sequence[str] = ()) -> DataFrame:
    """by..., idx, register from a column of uniform 64-bit hashes."""
    sizing.ull_precision(p)
    h = F.col(hash_)
    bit = H.leading_zeros(F.bitwise_not(F.shiftleft(F.bitwise_not(h), p))) + (p - 1)
    rows = df.where(h.isNotNull()).select(*by, F.shiftrightunsigned(h, 64 - p).cast("int").alias("idx"), _bit(bit).alias("_bit"))
    return rows.groupBy(*by, "idx").agg(F.bit_or("_bit").alias("_prefix")).select(*by, "idx", pack(F.col("_prefix")).alias("register"))


def registers(df: DataFrame, key: str, p: int, by: Sequence[str] = ()) -> DataFrame:
    """by..., idx, register: the non-empty registers.  Null keys are skipped."""
    return raw_registers(H.with_hash(df.select(*by, key), "_h", key, H.ULL_SEED), "_h", p, by)


def _by(state: DataFrame) -> list[str]:
    return [c for c in state.columns if c not in ("idx", "register")]


def downsize(state: DataFrame, p: int, to: int) -> DataFrame:
    """The state at a lower precision, equal to direct ingestion there; unchanged if ``to`` is not lower."""
    sizing.ull_precision(to)
    if to >= p:
        return state
    d = p - to
    offset = F.col("idx").bitwiseAND(F.lit((1 << d) - 1)).cast("long")
    bit = F.when(offset == 0, unpack(F.col("register"))).otherwise(_bit((H.leading_zeros(offset) + (p - 1)).bitwiseAND(F.lit(63))))
    rows = state.select(*_by(state), F.shiftright("idx", d).alias("idx"), bit.alias("_bits"))
    return rows.groupBy(*_by(state), "idx").agg(F.bit_or("_bits").alias("_prefix")).select(*_by(state), "idx", pack(F.col("_prefix")).alias("register"))


def merge(state: DataFrame, p: int, other: DataFrame, other_p: int) -> DataFrame:
    """Both at precision ``p``; ``other`` may be finer, not coarser."""
    same(other_p >= p, f"the other state has p={other_p}, which is coarser than p={p}")
    both = state.unionByName(downsize(other, other_p, p)).select(*_by(state), "idx", unpack(F.col("register")).alias("_bits"))
    return both.groupBy(*_by(state), "idx").agg(F.bit_or("_bits").alias("_prefix")).select(*_by(state), "idx", pack(F.col("_prefix")).alias("register"))


def merged(left: DataFrame, left_p: int, right: DataFrame, right_p: int) -> tuple[DataFrame, int]:
    """Both at the smaller of the two precisions."""
    if left_p <= right_p:
        return merge(left, left_p, right, right_p), left_p
    return merge(right, right_p, left, left_p), right_p


def estimate(state: DataFrame, p: int, by: Sequence[str] = (), estimator: str = "fgra") -> DataFrame:
    """by..., estimate."""
    require(estimator in ESTIMATORS, f"estimator={estimator!r}, wanted: one of {sorted(ESTIMATORS)}")
    entries = state.groupBy(*by, "register").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("register", "n"))).alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("used"))
    counts = F.concat(F.array(F.lit(1 << p) - F.col("used")), F.transform(F.sequence(F.lit(1), F.lit(255)), lambda r: F.coalesce(F.col("m")[r], F.lit(0).cast("long"))))

    @F.pandas_udf("double")
    def solve(c: pd.Series) -> pd.Series:
        return c.map(lambda x: ESTIMATORS[estimator]([int(i) for i in x], p)).astype(float)

    return entries.select(*by, solve(counts).alias("estimate"))


def count_distinct(df: DataFrame, key: str, p: int, by: Sequence[str] = (), estimator: str = "fgra") -> DataFrame:
    """by..., count."""
    return estimate(registers(df, key, p, by), p, by, estimator).withColumn("count", rounded(F.col("estimate"))).drop("estimate")


def relate(left: DataFrame, left_p: int, right: DataFrame, right_p: int) -> DataFrame:
    """left, right, union, intersection, jaccard: one row, at the common precision."""
    p = min(left_p, right_p)
    left, right = downsize(left, left_p, p), downsize(right, right_p, p)
    tagged = left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right"))).unionByName(merge(left, p, right, p).withColumn("side", F.lit("union")))
    got = estimate(tagged, p, ["side"]).groupBy().agg(*(F.coalesce(F.max(F.when(F.col("side") == s, F.col("estimate"))), F.lit(0.0)).alias(s) for s in ("left", "right", "union")))
    return got.select("*", inclusion_exclusion(F.col("left"), F.col("right"), F.col("union")).alias("x")).select("left", "right", "union", "x.*")


def to_state(state: DataFrame, p: int, by: Sequence[str] = ()) -> DataFrame:
    """by..., state: one binary of ``2**p`` register bytes for each group."""
    return dense.as_binary(state, by, "idx", "register", 1 << p, "state")


def from_state(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., p, idx, register; rows whose binary is no state raise an error when they are read."""
    n = F.length("state")
    p = F.log2(n.cast("double")).cast("int")
    sized = (n >= 8) & (n <= 1 << 26) & (n.bitwiseAND(n - 1) == 0)
    wrong = F.raise_error(F.lit("bad parameter: not an UltraLogLog state"))
    rows = states.select(*by, F.when(sized, p).otherwise(wrong.cast("int")).alias("p"), "state")
    rows = dense.from_binary(rows, [*by, "p"], "state", "idx", "register")
    return rows.withColumn("register", F.when(F.col("register") >= 4 * F.col("p") - 4, F.col("register")).otherwise(wrong.cast("int")))
