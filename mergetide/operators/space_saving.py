"""Space-Saving heavy hitters: at most ``capacity`` counters, each with a bound of its error."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import positive, same
from ..plans.aggregate import merge_states, summarise


class SpaceSaving:
    """Counters in buckets of equal count; of the smallest the one that changed last gives way."""

    def __init__(self, capacity: int):
        positive(capacity=capacity)
        self.capacity, self.total = capacity, 0
        self.entries: dict = {}  # item -> [count, error]
        self.buckets: dict[int, dict] = {}  # count -> its items, oldest first
        self.low = 0

    def add(self, items) -> None:
        for x in items.tolist() if hasattr(items, "tolist") else items:
            self._insert(x)

    def _insert(self, item) -> None:
        self.total += 1
        entry = self.entries.get(item)
        if entry is not None:
            self._leave(item, entry[0])
            entry[0] += 1
        elif len(self.entries) < self.capacity:
            self.entries[item] = entry = [1, 0]
            self.low = 1
        else:
            least = self.low
            victim, _ = self.buckets[least].popitem()
            del self.entries[victim]
            self.entries[item] = entry = [least + 1, least]
            self._left(least)
        self.buckets.setdefault(entry[0], {})[item] = None

    def _leave(self, item, count: int) -> None:
        del self.buckets[count][item]
        self._left(count)

    def _left(self, count: int) -> None:
        """Unit steps leave a smallest bucket only for the next count."""
        if not self.buckets[count]:
            del self.buckets[count]
            if self.low == count:
                self.low = count + 1

    @property
    def untracked(self) -> int:
        """What an item without a counter may have."""
        return self.low if len(self.entries) >= self.capacity else 0

    def merge(self, other: SpaceSaving) -> None:
        same(self.capacity == other.capacity, f"capacities {self.capacity} and {other.capacity}")
        mine, its = self.untracked, other.untracked
        both = {}
        for x in self.entries.keys() | other.entries.keys():
            a, b = self.entries.get(x, (mine, mine)), other.entries.get(x, (its, its))
            both[x] = [a[0] + b[0], a[1] + b[1]]
        kept = sorted(both.items(), key=lambda e: (-e[1][0], _sortable(e[0])))[: self.capacity]
        self._set(kept, self.total + other.total)

    def _set(self, entries, total: int) -> None:
        self.entries, self.buckets, self.total = {}, {}, total
        for x, e in sorted(entries, key=lambda e: (e[1][0], _sortable(e[0]))):
            self.entries[x] = list(e)
            self.buckets.setdefault(e[0], {})[x] = None
        self.low = min(self.buckets, default=0)

    def estimate(self, item) -> tuple[int, int] | None:
        """(count, error): the truth lies in count - error .. count."""
        e = self.entries.get(item)
        return e and (e[0], e[1])

    def lower_bound(self, item) -> int | None:
        e = self.entries.get(item)
        return e and e[0] - e[1]

    def top_k(self, k: int) -> list[tuple]:
        ranked = sorted(self.entries.items(), key=lambda e: (-e[1][0], _sortable(e[0])))
        return [(x, c, e) for x, (c, e) in ranked[:k]]

    def clear(self) -> None:
        self.__init__(self.capacity)

    def dump(self) -> str:
        return json.dumps({"capacity": self.capacity, "total": self.total, "entries": [[x, *e] for c in sorted(self.buckets) for x in self.buckets[c] for e in [self.entries[x]]]})

    @staticmethod
    def load(text: str) -> SpaceSaving:
        state = json.loads(text)
        out = SpaceSaving(state["capacity"])
        for x, c, e in state["entries"]:
            out.entries[x] = [c, e]
            out.buckets.setdefault(c, {})[x] = None
        out.total, out.low = state["total"], min(out.buckets, default=0)
        return out


def _sortable(x):
    return (isinstance(x, str), x)


def build(df: DataFrame, item: str, capacity: int, by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """by..., item, count, error, capacity: the entries.  Null items are skipped."""
    positive(capacity=capacity)
    whole = dict(df.dtypes)[item] in ("tinyint", "smallint", "int", "bigint")
    rows = df.select(*by, F.col(item).cast("long" if whole else "string").alias("_v"), *order)
    return entries(summarise(rows, by, ["_v"], lambda pid: SpaceSaving(capacity), SpaceSaving.load, order), by, whole)


def entries(states: DataFrame, by: Sequence[str], whole: bool) -> DataFrame:
    schema = f"array<struct<item: {'long' if whole else 'string'}, count: long, error: long>>"

    @F.pandas_udf(schema)
    def unfold(state: pd.Series) -> pd.Series:
        return state.map(lambda s: [{"item": x, "count": c, "error": e} for x, c, e in json.loads(s)["entries"]])

    capacity = F.get_json_object("state", "$.capacity").cast("int")
    return states.select(*by, capacity.alias("capacity"), F.explode(unfold("state")).alias("e")).select(*by, "e.item", "e.count", "e.error", "capacity")


def describe(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., tracked, capacity, untracked: items with counters, and what any other item may have at most."""
    full = F.count(F.lit(1)) >= F.max("capacity")
    return summary.groupBy(*by).agg(F.count(F.lit(1)).alias("tracked"), F.max("capacity").alias("capacity"), F.when(full, F.min("count")).otherwise(F.lit(0)).alias("untracked"))


def merge(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entries of two summaries of one capacity: a full outer join; what one side lacks counts as its minimum if it is full."""
    keys = [*by, "item"]

    def least(side: DataFrame, name: str) -> DataFrame:
        full = F.count(F.lit(1)) >= F.max("capacity")
        return side.groupBy(*by).agg(F.when(full, F.min("count")).otherwise(F.lit(0)).alias(name), F.max("capacity").alias(f"{name}_capacity"))

    a, b = (s.select(*keys, F.col("count").alias(f"{n}c"), F.col("error").alias(f"{n}e")) for s, n in ((left, "a"), (right, "b")))
    both = a.join(b, keys, "full_outer")
    for side, name in ((left, "am"), (right, "bm")):
        both = both.withColumn("_one", F.lit(1)).join(least(side, name).withColumn("_one", F.lit(1)), [*by, "_one"], "left").drop("_one")
    fits = F.col("am_capacity").isNull() | F.col("bm_capacity").isNull() | (F.col("am_capacity") == F.col("bm_capacity"))
    capacity = F.when(fits, F.coalesce("am_capacity", "bm_capacity")).otherwise(F.raise_error(F.lit("states do not fit together: their capacities differ")).cast("int"))
    part = lambda x, m: F.coalesce(x, m, F.lit(0))
    out = both.select(*keys, (part("ac", "am") + part("bc", "bm")).alias("count"), (part("ae", "am") + part("be", "bm")).alias("error"), capacity.alias("capacity"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("count").desc(), "item"))
    return out.withColumn("_r", rank).where(F.col("_r") <= F.col("capacity")).drop("_r")


def top_k(summary: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k entries of each group with the largest counts; ties by item."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("count").desc(), "item"))
    return summary.withColumn("rank", rank).where(F.col("rank") <= k)


def estimate(summary: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """keys..., count, error, lower_bound: nulls for items without a counter."""
    found = summary.select(F.col("item").alias(key), "count", "error", (F.col("count") - F.col("error")).alias("lower_bound"))
    return keys.join(found, key, "left")
