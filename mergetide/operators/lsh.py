"""Banded candidate search over MinHash signatures: postings, candidates, ranked neighbours.

A band is kept whole as the key of its posting, so candidates never meet by a collision of band hashes.  For joins
of a collection with itself, equal signatures are one class first; pairs are between classes, and a second table
says who belongs to which.  What a plan needs more than once is staged, so the collection is read and hashed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require, same
from ..functions import sizing
from ..sources.staged import small, stage
from . import marks, minhash

#: Members of a band that one task pairs with the others; a larger band is dealt over more tasks.
BAND_ROWS = 1000


def postings(signatures: DataFrame, hashes: int, bands: int, id_: str = "id") -> DataFrame:
    """id, band, band_key from compact signatures, row by row, or from the long form."""
    rows = sizing.lsh_rows(hashes, bands)
    if "signature" not in signatures.columns:
        signatures = minhash.compact(signatures, [id_])
    mark = marks.read(signatures, "signature")
    same(mark is None or mark["k"] == hashes, f"signatures of {mark and mark['k']} components, wanted: {hashes}")
    key = lambda b: F.array_join(F.transform(F.slice("signature", b * rows + 1, rows), lambda h: h.cast("string")), ",")
    return signatures.select(id_, F.posexplode(F.array(*map(key, range(bands)))).alias("band", "band_key"))


def upsert(signatures: DataFrame, newer: DataFrame, id_: str = "id") -> DataFrame:
    """Signatures in which the ids of ``newer`` are replaced."""
    return remove(signatures, newer.select(id_).distinct(), id_).unionByName(newer)


def remove(index: DataFrame, ids: DataFrame, id_: str = "id") -> DataFrame:
    """Signatures or postings without the ids."""
    return index.join(ids.select(id_), id_, "left_anti")


def size(index: DataFrame, id_: str = "id") -> int:
    """How many ids an index holds; 0 for one whose ids are all removed."""
    return index.agg(F.countDistinct(id_)).first()[0]


def candidates(queries: DataFrame, index: DataFrame, query: str = "q", id_: str = "id") -> DataFrame:
    """query, id: the ids that share a band with a query, once each.  Both are postings."""
    return queries.join(index, ["band", "band_key"]).select(query, id_).distinct()


def top_k(pairs: DataFrame, queries: DataFrame, index: DataFrame, k: int, query: str = "q", id_: str = "id") -> DataFrame:
    """query, id, score, rank: each query's best candidates by similarity, ties by larger id; compact signatures on both sides."""
    require(k >= 0, f"k={k!r}, wanted: 0 or more")
    scored = pairs.join(queries.select(query, F.col("signature").alias("_a")), query).join(index.select(id_, F.col("signature").alias("_b")), id_)
    scored = scored.select(query, id_, minhash.jaccard(F.col("_a"), F.col("_b")).alias("score"))
    best = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(id_).desc())
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(signatures: DataFrame, wanted, hashes: int, bands: int, k: int, id_: str = "id") -> DataFrame:
    """q, id, score, rank: the ``k`` best candidates of each id of compact ``signatures`` for which ``wanted`` holds."""
    index = stage(signatures, "signatures")
    posted = stage(postings(index, hashes, bands, id_), "postings")
    pairs = candidates(posted.where(wanted).withColumnRenamed(id_, "q"), posted, "q", id_)
    return top_k(pairs, index.where(wanted).withColumnRenamed(id_, "q"), index, k, "q", id_)


def classes(compact: DataFrame, id_: str = "id") -> DataFrame:
    """id, rep: the smallest id with the same signature."""
    keyed = compact.select(id_, F.md5(F.array_join(F.transform("signature", lambda x: x.cast("string")), ",")).alias("_s"))
    return keyed.join(keyed.groupBy("_s").agg(F.min(id_).alias("rep")), "_s").select(id_, "rep")


def self_join(compact: DataFrame, hashes: int, bands: int, id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives ``a < b`` with ``score``, membership ``id, rep``).

    Bands with a single member are left out before the join, and the members of a large one are dealt over as many
    tasks as it has ``BAND_ROWS``.
    """
    compact = stage(compact.select(id_, "signature"), "signatures")
    members = stage(classes(compact, id_), "classes")
    reps = stage(compact.join(members.where(F.col(id_) == F.col("rep")).select(id_), id_, "left_semi"), "representatives")
    posted = stage(postings(reps, hashes, bands, id_), "postings")
    sizes = stage(posted.groupBy("band", "band_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "bands")
    shared = stage(posted.join(small(sizes), ["band", "band_key"]).withColumn("_salts", F.ceil(F.col("_n") / BAND_ROWS)), "shared")
    a = shared.select("band", "band_key", F.pmod(F.xxhash64(id_), "_salts").alias("_salt"), F.col(id_).alias("a"))
    b = shared.select("band", "band_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt"), F.col(id_).alias("b"))
    pairs = a.join(b, ["band", "band_key", "_salt"]).where("a < b").select("a", "b").distinct()
    sides = [reps.select(F.col(id_).alias(x), F.col("signature").alias(f"_{x}")) for x in "ab"]
    scored = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", minhash.jaccard(F.col("_a"), F.col("_b")).alias("score"))
    return scored, members
