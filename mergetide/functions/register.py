"""SQL functions: estimators and scalar helpers for use in ``spark.sql``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.kll import Kll
from ..operators.tdigest import TDigest
from . import estimators


def register(spark: SparkSession) -> None:
    """``hll_estimate(registers)``, ``ull_estimate_fgra(state)``, ``ull_estimate_mle(state)`` on binaries of one byte for each
    register; ``kll_value(state, q)``, ``tdigest_value(state, q)``; ``minhash_similarity(a, b)`` on signatures."""

    def hll(registers: pd.Series) -> pd.Series:
        def one(b):
            p = len(b).bit_length() - 1
            return estimators.hll(estimators.registers_histogram(b)[: 64 - p + 2])

        return registers.map(one).astype(float)

    def ull(solve):
        def many(states: pd.Series) -> pd.Series:
            return states.map(lambda b: solve(estimators.registers_histogram(b), len(b).bit_length() - 1)).astype(float)

        return many

    def value(kernel):
        def many(states: pd.Series, q: pd.Series) -> pd.Series:
            return pd.Series([kernel.load(s).quantile(x) for s, x in zip(states, q, strict=True)], dtype=float)

        return many

    typed = lambda f: F.pandas_udf(f, "double")
    spark.udf.register("hll_estimate", typed(hll))
    spark.udf.register("ull_estimate_fgra", typed(ull(estimators.ull_fgra)))
    spark.udf.register("ull_estimate_mle", typed(ull(estimators.ull_mle)))
    spark.udf.register("kll_value", typed(value(Kll)))
    spark.udf.register("tdigest_value", typed(value(TDigest)))

    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if not len(x) and not len(y) else 0.0 if not len(x) or not len(y) else float((x == y).mean()) for x, y in zip(a, b, strict=True)], dtype=float)

    spark.udf.register("minhash_similarity", typed(similar))
