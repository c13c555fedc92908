"""Uniform samples: bottom-k by a random key, which merges and reruns alike, and Algorithm R for one ordered stream."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import positive
from ..functions import hashing as H


def sample(df: DataFrame, row_id: str, k: int, by: Sequence[str] = (), seed: int = H.RESERVOIR_RNG) -> DataFrame:
    """The k rows of each group with the smallest keys, with their ``rank`` from 1; keys depend on ``row_id`` alone."""
    positive(k=k)
    keyed = H.with_hash(df, "_key", row_id, seed)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(H.unsigned(F.col("_key")), row_id))
    return keyed.withColumn("rank", rank).where(F.col("rank") <= k).drop("_key")


def merge(left: DataFrame, right: DataFrame, row_id: str, k: int, by: Sequence[str] = (), seed: int = H.RESERVOIR_RNG) -> DataFrame:
    """The sample of the union, from two samples of disjoint rows."""
    return sample(left.drop("rank").unionByName(right.drop("rank")), row_id, k, by, seed)


class Reservoir:
    """Algorithm R with a fixed generator."""

    def __init__(self, capacity: int):
        positive(capacity=capacity)
        self.capacity, self.samples, self.seen, self.rng = capacity, [], 0, H.RESERVOIR_RNG

    def add(self, item) -> None:
        self.seen += 1
        if len(self.samples) < self.capacity:
            self.samples.append(item)
            return
        self.rng = H.splitmix64((self.rng + H.INCREMENT) & H.MASK)
        if (at := self.rng % self.seen) < self.capacity:
            self.samples[at] = item

    def extend(self, items: Iterable) -> None:
        for x in items:
            self.add(x)

    def clear(self) -> None:
        self.samples, self.seen = [], 0
