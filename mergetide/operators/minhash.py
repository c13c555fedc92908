"""MinHash signatures: the unsigned minimum of each component's hash over a set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import positive
from ..functions import hashing as H
from . import marks

#: Components that a row is hashed for at once; a wider signature takes a row for each so many.  More in one row would
#: make the generated method too long for the JVM to compile (32 take four times as long as 8).
WIDTH = 8


def component_seeds(k: int, family: int = H.MINHASH_FAMILY) -> list[int]:
    positive(k=k)
    return [H.splitmix64((i + family) & H.MASK) for i in range(k)]


def signatures(df: DataFrame, token: str, k: int, by: Sequence[str], family: int = H.MINHASH_FAMILY) -> DataFrame:
    """by..., signature: an array of the components in order.  Null tokens are skipped.

    One grouped minimum of all components, combined before its shuffle; a minimum doesn't mind repeated tokens.
    """
    seeds = [H.long(H.splitmix64(s)) for s in component_seeds(k, family)]
    rows = df.where(F.col(token).isNotNull()).select(*by, H.key64(df, token).alias("_key"))
    own = list(by)
    if k > WIDTH:
        padded = [*seeds, *[F.lit(None).cast("long")] * (-k % WIDTH)]
        part = lambda c: F.struct(F.lit(c).alias("c"), *(s.alias(f"s{j}") for j, s in enumerate(padded[c * WIDTH : (c + 1) * WIDTH])))
        rows = rows.withColumn("_s", F.explode(F.array(*map(part, range(len(padded) // WIDTH))))).withColumn("_c", F.col("_s.c"))
        own, seeds = [*by, "_c"], [F.col(f"_s.s{j}") for j in range(WIDTH)]
    columns = [f"_h{j}" for j in range(len(seeds))]
    rows = H.with_mixes(rows, dict(zip(columns, (F.col("_key").bitwiseXOR(s) for s in seeds), strict=True)))
    least = rows.groupBy(*own).agg(*(F.min(H.unsigned(F.col(c))).alias(c) for c in columns))
    least = least.select(*own, F.array(*(H.unsigned(F.col(c)) for c in columns)).alias("signature"))
    if k > WIDTH:
        parts = F.sort_array(F.collect_list(F.struct("_c", "signature")))
        least = least.groupBy(*by).agg(F.slice(F.flatten(F.transform(parts, lambda p: p["signature"])), 1, k).alias("signature"))
    return marks.mark(least, "signature", k=k, family=family)


def signature(df: DataFrame, token: str, k: int, by: Sequence[str], family: int = H.MINHASH_FAMILY) -> DataFrame:
    """by..., i, h: the components of each group's signature, in long form."""
    return marks.mark(signatures(df, token, k, by, family).select(*by, F.posexplode("signature").alias("i", "h")), "i", k=k, family=family)


def merge(*states: DataFrame) -> DataFrame:
    """Component-wise minimum of states, in long form, of one width and family."""
    out = marks.union(states, "i")
    least = out.groupBy(*[c for c in out.columns if c != "h"]).agg(F.min(H.unsigned(F.col("h"))).alias("_m"))
    return least.withColumn("h", H.unsigned(F.col("_m"))).drop("_m")


def compact(state: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., signature from the long form."""
    out = state.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("signature"))
    mark = marks.read(state, "i")
    return marks.mark(out, "signature", **mark) if mark else out


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two compact signatures; null or empty stands for the empty set: two of them are alike, one is not."""
    blank = lambda x: F.coalesce(F.size(x) <= 0, F.lit(True))
    share = F.size(F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda x: x)) / F.size(left)
    checked = F.when(F.size(left) == F.size(right), share).otherwise(F.raise_error(F.lit("states do not fit together: signatures of two widths")).cast("double"))
    return F.when(blank(left) & blank(right), 1.0).when(blank(left) | blank(right), 0.0).otherwise(checked)
