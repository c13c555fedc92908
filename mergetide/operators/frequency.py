"""Frequency tables of counters: Count-Min, linear and conservative, and the signed Count Sketch.

Cells are found by multiply-shift hashing of the 64-bit key.  Linear tables are sums by (row, col), so they are built and
merged by grouping.  Conservative updates depend on the order: keys are counted first, each key goes to one
task, and the tables of tasks are added, which keeps every estimate an upper bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import positive, power_of_two, require
from ..functions import hashing as H
from ..functions import sizing
from . import marks


def _wide(stream: Iterator[int]) -> int:
    return next(stream) << 64 | next(stream)


def _pair(x: int) -> Column:
    return F.struct(H.long(x >> 64).alias("hi"), H.long(x & H.MASK).alias("lo"))


@dataclass(frozen=True)
class Table:
    width: int
    depth: int
    seed: int

    def __post_init__(self):
        power_of_two(width=self.width)
        positive(depth=self.depth)

    @property
    def bits(self) -> int:
        return self.width.bit_length() - 1

    def _located(self, df: DataFrame, key: str, rows: Column) -> DataFrame:
        """A row for each key and table row, with ``row``, ``col`` and what ``rows`` holds besides."""
        df = df.withColumn("_x", H.key64(df, key)).withColumn("_r", F.explode(rows))
        return H.with_multiply_shift(df, "col", "_x", F.col("_r.a"), F.col("_r.b"), self.bits).withColumn("row", F.col("_r.row"))

    @property
    def _parameters(self) -> dict:
        return {"kind": type(self).__name__, "width": self.width, "depth": self.depth, "seed": self.seed}

    def _own(self, state: DataFrame) -> DataFrame:
        return marks.check(state, "col", **self._parameters)

    def _marked(self, state: DataFrame) -> DataFrame:
        return marks.mark(state, "col", **self._parameters)

    def merge(self, *states: DataFrame) -> DataFrame:
        """Cell-wise sum of tables with the same shape and seed."""
        for s in states:
            self._own(s)
        out = marks.union(states, "col")
        return out.groupBy(*[c for c in out.columns if c != "c"]).agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class CountMin(Table):
    @classmethod
    def for_error(cls, epsilon: float, delta: float, seed: int) -> CountMin:
        return cls(*sizing.count_min_size(epsilon, delta), seed)

    def coefficients(self) -> list[tuple[int, int]]:
        stream, mask = H.seed_stream(self.seed ^ H.COUNT_MIN_ROWS), (1 << (64 + max(0, self.bits - 1))) - 1
        return [(_wide(stream) & mask, _wide(stream) & mask) for _ in range(self.depth)]

    def locate(self, df: DataFrame, key: str) -> DataFrame:
        return self._located(df, key, F.array(*[F.struct(F.lit(i).alias("row"), _pair(a).alias("a"), _pair(b).alias("b")) for i, (a, b) in enumerate(self.coefficients())]))

    def build(self, df: DataFrame, key: str, count: str | None = None, by: Sequence[str] = ()) -> DataFrame:
        """by..., row, col, c: the linear table.  Null keys and counts that are null or not positive are skipped."""
        n = F.lit(1).cast("long") if count is None else F.col(count).cast("long")
        rows = df.select(*by, key, n.alias("_n")).where(F.col(key).isNotNull() & (F.col("_n") > 0))
        rows = rows.groupBy(*by, key).agg(F.sum("_n").alias("_n"))
        return self._marked(self.locate(rows, key).groupBy(*by, "row", "col").agg(F.sum("_n").alias("c")))

    @staticmethod
    def total(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """by..., total: the weight in a linear table, which every row holds once."""
        return state.where("row = 0").groupBy(*by).agg(F.sum("c").alias("total"))

    def build_conservative(self, df: DataFrame, key: str, count: str | None = None, partitions: int | None = None) -> DataFrame:
        """row, col, c with conservative updates, keys in ascending order within each of ``partitions`` tasks."""
        n = F.lit(1).cast("long") if count is None else F.col(count).cast("long")
        keyed = df.select(H.key64(df, key).alias("_x"), n.alias("_n")).where("_x is not null and _n > 0").groupBy("_x").agg(F.sum("_n").alias("_n"))
        dealt = keyed.repartition(partitions, "_x") if partitions else keyed.repartition("_x")
        rows, shift, mask, bits, depth = self.coefficients(), 63, (1 << (63 + self.bits)) - 1, self.bits, self.depth

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells: list[dict[int, int]] = [{} for _ in range(depth)]
            for batch in batches:
                for x, n in zip(batch["_x"].tolist(), batch["_n"].tolist(), strict=True):
                    x &= H.MASK
                    at = [((a * x + b) & mask) >> shift if bits else 0 for a, b in rows]
                    goal = min(c.get(i, 0) for c, i in zip(cells, at, strict=True)) + n
                    for c, i in zip(cells, at, strict=True):
                        if c.get(i, 0) < goal:
                            c[i] = goal
            if any(cells):
                yield pd.DataFrame([(r, i, v) for r, c in enumerate(cells) for i, v in c.items()], columns=["row", "col", "c"])

        return self.merge(self._marked(dealt.sortWithinPartitions("_x").mapInPandas(fold, "row int, col long, c long")))

    def estimate(self, keys: DataFrame, key: str, state: DataFrame) -> DataFrame:
        """keys..., estimate: the smallest cell, 0 where one is empty.  A row for each distinct row of ``keys``."""
        cells = self.locate(keys.distinct(), key).join(self._own(state), ["row", "col"], "left")
        return cells.groupBy(*keys.columns).agg(F.min(F.coalesce("c", F.lit(0).cast("long"))).alias("estimate"))


@dataclass(frozen=True)
class CountSketch(Table):
    def __post_init__(self):
        super().__post_init__()
        require(self.depth % 2 == 1, f"depth={self.depth!r}, wanted: an odd number")

    @classmethod
    def for_error(cls, epsilon: float, delta: float, seed: int) -> CountSketch:
        return cls(*sizing.count_sketch_size(epsilon, delta), seed)

    def coefficients(self) -> list[tuple[int, int, int, int]]:
        stream, mask = H.seed_stream(self.seed ^ H.COUNT_SKETCH_ROWS), (1 << (64 + max(0, self.bits - 1))) - 1
        return [(_wide(stream) & mask, _wide(stream) & mask, next(stream), next(stream)) for _ in range(self.depth)]

    def locate(self, df: DataFrame, key: str) -> DataFrame:
        """Adds ``row``, ``col`` and ``sign``."""
        rows = [F.struct(F.lit(i).alias("row"), _pair(a).alias("a"), _pair(b).alias("b"), H.long(m).alias("m"), H.long(o).alias("o")) for i, (a, b, m, o) in enumerate(self.coefficients())]
        df = self._located(df, key, F.array(*rows))
        with H.wrapping(df.sparkSession):
            return df.withColumn("sign", F.when(F.col("_r.m") * F.col("_x") + F.col("_r.o") >= 0, 1).otherwise(-1))

    def build(self, df: DataFrame, key: str, delta: str | None = None, by: Sequence[str] = ()) -> DataFrame:
        """by..., row, col, c.  A net sum beyond a long fails, as ``sum`` does in ANSI mode; so does the least long."""
        n = F.lit(1).cast("long") if delta is None else F.col(delta).cast("long")
        rows = df.select(*by, key, n.alias("_n")).where(F.col(key).isNotNull() & (F.col("_n") != 0)).groupBy(*by, key).agg(F.sum("_n").alias("_n"))
        least = F.raise_error(F.lit("overflow: the least long has no counterpart of the other sign")).cast("long")
        rows = rows.withColumn("_n", F.when(F.col("_n") == F.lit(H.MIN_LONG), least).otherwise(F.col("_n")))
        return self._marked(self.locate(rows, key).groupBy(*by, "row", "col").agg(F.sum(F.col("sign") * F.col("_n")).alias("c")))

    def estimate(self, keys: DataFrame, key: str, state: DataFrame) -> DataFrame:
        """keys..., estimate: the median of the signed cells, empty ones 0.  A row for each distinct row of ``keys``."""
        cells = self.locate(keys.distinct(), key).join(self._own(state), ["row", "col"], "left")
        values = F.sort_array(F.collect_list(F.col("sign") * F.coalesce("c", F.lit(0).cast("long"))))
        return cells.groupBy(*keys.columns).agg(values.alias("_v")).select(*keys.columns, F.col("_v")[self.depth // 2].alias("estimate"))
