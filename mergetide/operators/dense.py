"""Occupied cells of a group as one dense value: the cells are sorted and the gaps between them filled, in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(state: DataFrame, by: Sequence[str], index: Column, value: Column) -> DataFrame:
    return state.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(index.cast("int").alias("i"), value.cast("long").alias("v")))).alias("_c"))


def _gap(x: Column, k: Column) -> Column:
    return x["i"] - F.coalesce(F.get(F.col("_c"), k - 1)["i"], F.lit(-1)) - 1


def _tail(size: int) -> Column:
    return F.lit(size - 1) - F.coalesce(F.try_element_at(F.col("_c"), F.lit(-1))["i"], F.lit(-1))


def as_binary(state: DataFrame, by: Sequence[str], index: str, value: str, size: int, out: str) -> DataFrame:
    """by..., out: a byte for each of ``size`` cells."""
    pieces = F.transform("_c", lambda x, k: F.concat(F.repeat(F.lit("00"), _gap(x, k)), F.lpad(F.hex(x["v"]), 2, "0")))
    digits = F.concat(F.array_join(pieces, ""), F.repeat(F.lit("00"), _tail(size)))
    return _cells(state, by, F.col(index), F.col(value)).select(*by, F.unhex(digits).alias(out))


def as_longs(state: DataFrame, by: Sequence[str], index: Column, value: Column, size: int, out: str) -> DataFrame:
    """by..., out: an array with a long for each of ``size`` cells."""
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    pieces = F.transform("_c", lambda x, k: F.concat(zeros(_gap(x, k)), F.array(x["v"])))
    return _cells(state, by, index, value).select(*by, F.concat(F.flatten(pieces), zeros(_tail(size))).alias(out))


def byte_at(binary: str, at: Column) -> Column:
    return F.conv(F.hex(F.substring(F.col(binary), at + 1, F.lit(1))), 16, 10).cast("int")


def from_binary(rows: DataFrame, keep: Sequence[str], binary: str, index: str, value: str) -> DataFrame:
    """keep..., index, value: a row for each byte that is not zero.

    The bytes are read in one expression, so no row carries the binary, and once: a plain explode asks for the array's size first.
    """
    every = F.transform(F.sequence(F.lit(0), F.length(binary) - 1), lambda i: byte_at(binary, i))
    return rows.select(*keep, F.posexplode_outer(F.when(F.length(binary) > 0, every)).alias(index, value)).where(F.col(value) > 0)
