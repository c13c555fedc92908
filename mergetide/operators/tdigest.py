"""t-digests: centroids that are small at the ends of the distribution, with exact extremes.

After Dunning's merging digest: centroids and new values are sorted together, cut into runs whose weight is bounded by
``4 * N / compression * q * (1 - q)`` at the middle of the run, and each run becomes a centroid.  Between centroids the
distribution is a line through their middles; a centroid of one value is a step.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require, same
from ..plans.aggregate import merge_states, summarise
from .kll import check_quantile, order_key

#: Values that wait for the next compression, as a multiple of it.
BUFFER = 10


def blend(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The point at ``t`` between a <= b, as a convex sum, which can't overflow."""
    return np.clip(a * (1 - t) + b * t, a, b)


class TDigest:
    def __init__(self, compression: float):
        require(math.isfinite(compression) and compression >= 10, f"compression={compression!r}, wanted: 10 or more")
        self.compression = float(compression)
        self.clear()

    def clear(self) -> None:
        self.means, self.weights = np.empty(0), np.empty(0)
        self.buffer: list[float] = []
        self.total, self.low, self.high = 0.0, math.inf, -math.inf

    def add(self, values) -> None:
        """Finite values; the state doesn't depend on how they are cut into calls."""
        values = np.asarray(values, float)
        values = values[np.isfinite(values)]
        if not len(values):
            return
        self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        most, at = math.ceil(self.compression * BUFFER), 0
        while at < len(values):
            taken = values[at : at + most - len(self.buffer)]
            self.buffer += taken.tolist()
            self.total += len(taken)
            at += len(taken)
            if len(self.buffer) == most:
                self.compress()

    def centroids(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and weights in order, waiting values among them."""
        means, weights = np.append(self.means, self.buffer), np.append(self.weights, np.ones(len(self.buffer)))
        order = np.argsort(order_key(means), kind="stable")
        return means[order], weights[order]

    def compress(self) -> None:
        means, weights = self.centroids()
        if len(means):
            self._cluster(means, weights)
        self.buffer = []

    def _cluster(self, means: np.ndarray, weights: np.ndarray) -> None:
        edges = np.append(0.0, np.cumsum(weights)).tolist()
        scale, starts, begin = 4 * self.total / self.compression, [0], 0.0
        for i in range(1, len(means)):
            middle = (begin + edges[i + 1]) / (2 * self.total)
            if edges[i + 1] - begin > max(1.0, scale * middle * (1 - middle)):
                starts.append(i)
                begin = edges[i]
        sums = np.add.reduceat(weights, starts)
        share = weights / np.repeat(sums, np.diff([*starts, len(means)]))
        with np.errstate(over="ignore"):
            centre = np.add.reduceat(means * share, starts)
        self.means = np.clip(centre, np.minimum.reduceat(means, starts), np.maximum.reduceat(means, starts))
        self.weights = sums

    def merge(self, other: TDigest) -> None:
        same(math.isclose(self.compression, other.compression, rel_tol=0, abs_tol=1e-12), f"compression is {self.compression} here and {other.compression} there")
        self.low, self.high, self.total = min(self.low, other.low), max(self.high, other.high), self.total + other.total
        means, weights = other.centroids()
        self.means, self.weights = np.append(self.means, means), np.append(self.weights, weights)
        self.compress()

    def _knots(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions among the sorted values and the values there: both edges of single values, middles of larger centroids, and the extremes."""
        means, weights = self.centroids()
        end = np.cumsum(weights)
        begin, single = end - weights, weights == 1
        middle = begin + weights / 2
        at = np.stack([np.where(single, begin, middle), np.where(single, end, middle)], axis=1).ravel()
        first, last = ([1.0], [self.low]) if not single[0] else ([], []), ([self.total - 1], [self.high]) if not single[-1] else ([], [])
        return np.concatenate([first[0], at, last[0]]), np.concatenate([first[1], np.repeat(means, 2), last[1]])

    def quantiles(self, queries: Sequence[float]) -> list[float]:
        for q in queries:
            check_quantile(q)
        if not len(queries):
            return []
        require(self.total > 0, "a quantile of no values at all")
        x, v = self._knots()
        q = np.asarray(queries, float)
        at = q * self.total
        i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
        width = x[i + 1] - x[i]
        t = np.clip(np.where(width > 0, (at - x[i]) / np.where(width > 0, width, 1), at >= x[i + 1]), 0, 1)
        out = blend(v[i], v[i + 1], t)
        out = np.where((at < 1) | (q == 0), self.low, out)
        return np.where((at > self.total - 1) | (q == 1), self.high, out).tolist()

    def quantile(self, q: float) -> float:
        return self.quantiles([q])[0]

    def dump(self) -> str:
        return json.dumps({"compression": self.compression, "total": self.total, "extremes": [self.low, self.high] if self.total else None, "centroids": list(zip(self.means.tolist(), self.weights.tolist())), "buffer": self.buffer})

    @staticmethod
    def load(text: str) -> TDigest:
        state = json.loads(text)
        out = TDigest(state["compression"])
        out.total, (out.low, out.high) = state["total"], state["extremes"] or (math.inf, -math.inf)
        out.means, out.weights = np.array(state["centroids"], float).reshape(-1, 2).T
        out.buffer = state["buffer"]
        return out


def build(df: DataFrame, value: str, compression: float, by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """by..., state.  Nulls, NaN and infinities are skipped."""
    TDigest(compression)
    rows = df.select(*by, F.col(value).cast("double").alias("_v"), *order)
    return summarise(rows, by, ["_v"], lambda pid: TDigest(compression), TDigest.load, order)


def merge(*states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = None
    for i, s in enumerate(states):
        s = s.withColumn("_pid", F.lit(i))
        out = s if out is None else out.unionByName(s)
    return merge_states(out, by, TDigest.load)


def describe(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., compression, count, centroids (merged and waiting)."""
    get = lambda name: F.get_json_object("state", f"$.{name}")
    return states.select(*by, get("compression").cast("double").alias("compression"), get("total").cast("double").alias("count"), (F.json_array_length(get("centroids")) + F.json_array_length(get("buffer"))).alias("centroids"))


def quantiles(states: DataFrame, queries: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by..., q, value; an empty digest gives nulls."""
    for q in queries:
        check_quantile(q)

    @F.pandas_udf("array<double>")
    def ask(state: pd.Series) -> pd.Series:
        return state.map(lambda s: x.quantiles(queries) if (x := TDigest.load(s)).total else [None] * len(queries))

    rows = states.select(*by, F.posexplode(ask("state")).alias("_i", "value"))
    return rows.select(*by, F.element_at(F.array(*[F.lit(float(q)) for q in queries]), F.col("_i") + 1).alias("q"), "value")
