"""MinMax summaries: cells keep the smallest value, an answer is the largest of a key's cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import positive, require
from ..functions import hashing as H
from . import marks


@dataclass(frozen=True)
class MinMax:
    """``reverse`` turns the order of values around: cells keep the largest, answers are the smallest."""

    width: int
    depth: int
    seed: int
    reverse: bool = False

    def __post_init__(self):
        positive(width=self.width, depth=self.depth)
        require(self.width < 1 << 31, f"width={self.width!r}, wanted: below 2**31")

    def seeds(self) -> list[int]:
        return list(islice(H.seed_stream(self.seed ^ H.MIN_MAX_ROWS), self.depth))

    @property
    def _cell(self):
        return F.max if self.reverse else F.min

    def locate(self, df: DataFrame, key: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(i).alias("row"), H.long(s).alias("s")) for i, s in enumerate(self.seeds())])
        df = df.withColumn("_x", H.key64(df, key)).withColumn("_r", F.explode(rows))
        df = H.with_mix(df, "_h", F.col("_x").bitwiseXOR(F.col("_r.s")))
        return df.withColumn("row", F.col("_r.row")).withColumn("col", H.scaled(F.col("_h"), self.width))

    def build(self, df: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
        """by..., row, col, v: the occupied cells.  Rows with a null key or value are skipped."""
        rows = df.select(*by, key, F.col(value).alias("_v")).where(F.col(key).isNotNull() & F.col("_v").isNotNull()).groupBy(*by, key).agg(self._cell("_v").alias("_v"))
        return marks.mark(self.locate(rows, key).groupBy(*by, "row", "col").agg(self._cell("_v").alias("v")), "col", **asdict(self))

    def merge(self, *states: DataFrame) -> DataFrame:
        """Cell by cell, of summaries of the same shape, seed and order."""
        for s in states:
            marks.check(s, "col", **asdict(self))
        out = marks.union(states, "col")
        return out.groupBy(*[c for c in out.columns if c != "v"]).agg(self._cell("v").alias("v"))

    def estimate(self, keys: DataFrame, key: str, state: DataFrame) -> DataFrame:
        """keys..., v: null if one of the key's cells is empty.  A row for each distinct row of ``keys``."""
        answer = F.min if self.reverse else F.max
        cells = self.locate(keys.distinct(), key).join(marks.check(state, "col", **asdict(self)), ["row", "col"], "left")
        return cells.groupBy(*keys.columns).agg(F.when(F.count("v") == self.depth, answer("v")).alias("v"))
