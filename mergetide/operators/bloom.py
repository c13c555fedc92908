"""Bloom filters.  Long form: one row for each set bit; compact form: one row with an array of 64-bit words.

The bits do not depend on the order of the input, so a filter is built by ``distinct`` and merged by a union.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import positive
from ..functions import hashing as H
from ..functions import sizing
from ..sources.staged import stage
from . import dense, marks

#: Words up to which a compact filter is broadcast; above it the probe joins bits.
BROADCAST_WORDS = 1 << 20


@dataclass(frozen=True)
class Bloom:
    bits: int
    hashes: int

    def __post_init__(self):
        positive(bits=self.bits, hashes=self.hashes)

    @classmethod
    def for_items(cls, items: int, rate: float) -> Bloom:
        bits = sizing.bloom_bits(items, rate)
        return cls(bits, sizing.bloom_hashes(bits, items))

    def _hashed(self, df: DataFrame, key: str) -> DataFrame:
        return H.with_hash(H.with_hash(df, "_h1", key, H.BLOOM_SEED_A), "_h2", key, H.BLOOM_SEED_B)

    def _bits(self) -> list[Column]:
        """The bits of a key from its two hashes; call it where arithmetic wraps."""
        h1, h2 = F.col("_h1"), F.col("_h2").bitwiseOR(F.lit(1).cast("long"))
        return [H.unsigned_mod(h1 + h2 * F.lit(i).cast("long"), self.bits) for i in range(self.hashes)]

    def with_probes(self, df: DataFrame, key: str, out: str = "probes") -> DataFrame:
        """Adds the array of bits of a key (null for a null key)."""
        df = self._hashed(df, key)
        with H.wrapping(df.sparkSession):
            return df.withColumn(out, F.when(F.col("_h1").isNotNull(), F.array(*self._bits()))).drop("_h1", "_h2")

    def build(self, df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
        """by..., bit: the set bits.  Null keys are skipped.

        The outer form, as a plain explode filters by the array's size first, with the hashes written out in the scan.
        """
        rows = self.with_probes(df.select(*by, key), key).select(*by, F.explode_outer("probes").alias("bit")).where("bit is not null").distinct()
        return marks.mark(rows, "bit", bits=self.bits, hashes=self.hashes)

    def inserted(self, df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
        """by..., inserted: the insertions, repeated ones included."""
        return df.groupBy(*by).agg(F.count(key).alias("inserted"))

    @staticmethod
    def merge(*states: DataFrame) -> DataFrame:
        """The union of filters of the same size and number of hashes."""
        return marks.union(states, "bit").distinct()

    def compact(self, state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """by..., words: long form -> array of 64-bit words, the empty ones too."""
        words = state.groupBy(*by, F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
        return dense.as_longs(words, by, F.col("w"), F.col("v"), -(-self.bits // 64), "words")

    @staticmethod
    def expand(compact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """by..., bit: compact -> long form."""
        rows = compact.select(*by, F.posexplode("words").alias("w", "v")).where("v <> 0")
        rows = rows.select(*by, "w", "v", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
        return rows.where(F.expr("(shiftrightunsigned(v, i) & 1L) = 1")).select(*by, (F.col("w").cast("long") * 64 + F.col("i")).alias("bit"))

    def probe(self, df: DataFrame, key: str, state: DataFrame, out: str = "maybe") -> DataFrame:
        """Adds whether a key may be a member; false is certain, null keys give null.

        A filter of at most BROADCAST_WORDS words is staged and read by a scalar subquery, which each task gets once; a larger
        one is joined bit by bit for the distinct keys.  Each hash names the subquery, so it must be no more than a scan of one row.
        """
        marks.check(state, "bit", bits=self.bits, hashes=self.hashes)
        if -(-self.bits // 64) <= BROADCAST_WORDS:
            words = stage(self.compact(state).select("words"), "filter").scalar()
            rows = self._hashed(df, key)
            with H.wrapping(df.sparkSession):
                rows = rows.withColumns({f"_b{i}": b for i, b in enumerate(self._bits())})
            hit = F.lit(True)
            for b in (F.col(f"_b{i}") for i in range(self.hashes)):
                word = F.get(words, F.shiftright(b, 6).cast("int"))
                hit &= F.call_function("shiftrightunsigned", word, b.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
            return rows.withColumn(out, F.when(F.col("_h1").isNotNull(), hit)).drop("_h1", "_h2", *(f"_b{i}" for i in range(self.hashes)))
        keys = df.select(F.col(key).alias("_key")).where("_key is not null").distinct()
        probes = self.with_probes(keys, "_key").select("_key", F.explode_outer(F.array_distinct("probes")).alias("bit"))
        found = probes.join(state, "bit", "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_found"))
        need = probes.groupBy("_key").agg(F.count(F.lit(1)).alias("_need"))
        members = need.join(found, "_key").where("_found = _need").select("_key", F.lit(True).alias("_hit"))
        return df.join(members, F.col(key) == F.col("_key"), "left").withColumn(out, F.when(F.col(key).isNotNull(), F.coalesce("_hit", F.lit(False)))).drop("_key", "_hit")

    @staticmethod
    def _candidates(probed: DataFrame) -> DataFrame:
        """The rows that may have a partner.  A filter on ``_maybe`` itself would be pushed to the scan with all hashes written out in it; none passes a generated column."""
        return probed.select("*", F.explode_outer(F.array("_maybe")).alias("_candidate")).where("_candidate").drop("_maybe", "_candidate")

    def semi_join(self, left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
        """The rows of ``left`` with a partner in ``right``: the filter first, then the exact join on what is left."""
        kept = self._candidates(self.probe(left, key, self.build(right, right_key), "_maybe"))
        return kept.join(right.select(F.col(right_key).alias(key)).distinct(), key, "left_semi")

    def anti_join(self, left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
        """The rows of ``left`` without a partner; those that the filter refuses skip the exact join."""
        probed = self.probe(left, key, self.build(right, right_key), "_maybe")
        sure = self._candidates(probed.withColumn("_maybe", ~F.coalesce("_maybe", F.lit(False))))
        rest = self._candidates(probed).join(right.select(F.col(right_key).alias(key)).distinct(), key, "left_anti")
        return sure.unionByName(rest)
