"""What a state was built with, kept in the metadata of one of its columns, so that only states alike are merged.

States of other origin carry no mark and are taken at their word.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..errors import same

KEY = "built_with"


def mark(state: DataFrame, column: str, **parameters) -> DataFrame:
    return state.withMetadata(column, {**state.schema[column].metadata, KEY: json.dumps(parameters, sort_keys=True)})


def read(state: DataFrame, column: str) -> dict | None:
    text = state.schema[column].metadata.get(KEY)
    return text and json.loads(text)


def check(state: DataFrame, column: str, **parameters) -> DataFrame:
    """``state``, unless its mark names other parameters."""
    found = read(state, column)
    same(found is None or found == parameters, f"built with {found}, wanted {parameters}")
    return state


def union(states: tuple[DataFrame, ...], column: str) -> DataFrame:
    """The rows of all states, which have the same columns and whose marks agree; the first mark that there is stays."""
    first = next((m for s in states if (m := read(s, column))), None)
    out = states[0]
    for s in states:
        same(set(s.columns) == set(out.columns), f"columns are {out.columns} here and {s.columns} there")
        check(s, column, **(first or {}))
    for s in states[1:]:
        out = out.unionByName(s)
    return mark(out, column, **first) if first else out
