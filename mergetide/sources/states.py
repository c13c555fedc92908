"""Storing and loading states: Parquet whose first column carries the kind and parameters of the summary."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..errors import same


def save(state: DataFrame, path: str, kind: str, **parameters) -> None:
    first = state.columns[0]
    state.withMetadata(first, {**state.schema[first].metadata, "summary": json.dumps({"kind": kind, **parameters}, sort_keys=True)}).write.parquet(path)


def describe(spark: SparkSession, path: str) -> dict:
    """Kind and parameters of a stored state."""
    return json.loads(spark.read.parquet(path).schema.fields[0].metadata.get("summary", "{}"))


def load(spark: SparkSession, path: str, kind: str, **parameters) -> DataFrame:
    """The state; an error if it was stored with another kind or other parameters."""
    found = describe(spark, path)
    same(found == {"kind": kind, **parameters}, f"stored state is {found}, not {({'kind': kind, **parameters})}")
    return spark.read.parquet(path)
