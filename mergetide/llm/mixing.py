"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a fixed hash.  Words are summed by source and hash bucket, the bucket in which a
source's budget runs out is found in a running sum over at most ``2**BITS`` buckets, and only that bucket
is summed again with finer buckets.  What comes out is one threshold for each source; a document is then
taken by comparing its own hash, so the corpus is never sorted and a rerun takes the same documents.
Budgets are nested: a larger budget takes a superset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, key_of, small, stage

#: Hash bits used in all, and by each level.
HASH_BITS, LEVELS = 60, (12, 12, 12, 12, 12)
#: How often what is missing is filled up, and what share of it a document may then have.
FILLS, FILL = 3, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id; of the text where the id is null."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), text), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def slim(docs: DataFrame) -> DataFrame:
    """What mixing needs of each document, all of it computed from the row alone."""
    return docs.select("doc_id", key_of(F.col("source")).alias("key"), F.col("source").alias("by"), word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("h"))


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """``sizes`` (key, by, source_size), a row for each source -> the same with ``target``.

    The budget is the sum of all sizes.  Sources in order of size by weight reach their ceiling first, so
    one running sum tells who is capped and what level is left for the others.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy(F.col("by").asc_nulls_last())) - 1) % len(weights) + 1)
    t = sizes.withColumn("w", w).withColumn("cap", (max_repeats * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("by").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    t = t.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(order), F.lit(0.0))))
    t = t.withColumn("capped", F.col("level") * F.col("w") > F.col("cap"))
    t = t.withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
    return t.select("key", "by", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("final") * F.col("w"), F.col("cap"))).alias("target"))


def _boundary(rows: DataFrame, need: DataFrame) -> DataFrame:
    """Where the running sum of ``rows`` (key, size, h), by hash, first exceeds the ``need`` (key, need) of a key.

    key, edge, after, fits: all rows with h < edge together weigh ``fits``, at most the need, and the rows with
    edge <= h < after would exceed it; where all rows fit, edge and after are above all hashes.  Only the bucket in
    which the need runs out is summed again, until it holds a single document or rows of one hash.
    """
    open_ = need.select("key", "need", F.lit(0).cast("long").alias("fits"), F.lit(0).cast("long").alias("prefix"))
    shift = HASH_BITS
    for bits in LEVELS:
        part = rows.join(small(open_), "key").where(F.shiftright("h", shift) == F.col("prefix"))
        shift -= bits
        hist = part.groupBy("key", "need", "fits", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
        hist = hist.withColumn("upto", F.col("fits") + F.sum("n").over(Window.partitionBy("key").orderBy("b")))
        edge = hist.groupBy("key", "need").agg(F.min_by(F.struct("b", (F.col("upto") - F.col("n")).alias("fits"), "docs"), F.when(F.col("upto") > F.col("need"), F.col("b"))).alias("x"), F.max("upto").alias("all"))
        if shift == HASH_BITS - bits:
            whole = edge.where("x is null").select("key", F.lit(1 << HASH_BITS).alias("edge"), F.lit(1 << HASH_BITS).alias("after"), F.col("all").alias("fits"))
            whole = stage(whole, "whole")
        open_ = stage(edge.where("x is not null").select("key", "need", "x.fits", F.col("x.b").alias("prefix"), "x.docs"), "boundary")
        if (open_.agg(F.max("docs")).first()[0] or 0) <= 1:
            break
        open_ = open_.drop("docs")
    found = open_.select("key", F.shiftleft("prefix", shift).alias("edge"), F.shiftleft(F.col("prefix") + 1, shift).alias("after"), "fits")
    return found.unionByName(whole)


def thresholds(s: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``s``: rows of :func:`slim`, staged -> key, source_size, target, base, cut, fills for each source.

    All documents of a source are taken ``base`` times and those with h < cut once more.  The document at the
    boundary may be long, so what is then missing is filled, by the same search, from later documents of
    at most a ``FILL``-th of it, ``FILLS`` times over; unless taking the document at the boundary comes nearer.
    ``fills`` are structs (low, high, most): documents with low <= h < high and a size of at most ``most``.
    """
    sizes = s.groupBy("key", "by").agg(F.sum("size").alias("source_size"))
    t = source_targets(sizes, weights, max_repeats)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("base", F.least(base, F.lit(max_repeats).cast("long"))).withColumn("need", F.col("target") - F.col("base") * F.col("source_size"))
    t = stage(t.select("key", "source_size", "target", "base", "need"), "targets")
    rows = s.select("key", "size", "h")
    need = t.where("need > 0").select("key", "need")
    at = need.join(_boundary(rows, need), "key")
    beyond = rows.join(small(stage(at.select("key", "edge", "after"), "edges")), "key").where((F.col("h") >= F.col("edge")) & (F.col("h") < F.col("after"))).groupBy("key").agg(F.sum("size").alias("over"))
    at = at.join(beyond, "key", "left").select("key", (F.col("need") - F.col("fits")).alias("short"), "edge", "after", "over")
    at = stage(at.select("*", F.col("short").alias("missing"), F.col("after").alias("low"), F.array().cast("array<struct<low: long, high: long, most: double>>").alias("fills")), "cuts")
    for _ in range(FILLS):
        now = at.where("missing > 0").select("key", F.col("missing").alias("need"), "low", (F.col("missing") / FILL).alias("most"))
        later = rows.join(small(now.drop("need")), "key").where((F.col("h") >= F.col("low")) & (F.col("size") <= F.col("most"))).select("key", "size", "h")
        got = now.join(_boundary(later, now.select("key", "need")), "key").select("key", F.struct("low", F.col("edge").alias("high"), "most").alias("fill"), (F.col("need") - F.col("fits")).alias("rest"), F.col("after").alias("next"))
        at = at.join(got, "key", "left")
        some = F.col("fill").isNotNull()
        at = stage(at.select("key", "short", "edge", "after", "over", F.when(some, F.col("rest")).otherwise(F.col("missing")).alias("missing"), F.when(some, F.col("next")).otherwise(F.col("low")).alias("low"), F.when(some, F.array_append("fills", F.col("fill"))).otherwise(F.col("fills")).alias("fills")), "fills")
    nearer = F.col("over") - F.col("short") < F.col("missing")
    cut = at.select("key", F.when(nearer, F.col("after")).otherwise(F.col("edge")).alias("cut"), F.when(nearer, F.slice("fills", 1, 0)).otherwise(F.col("fills")).alias("fills"))
    return stage(t.join(cut, "key", "left").select("key", "source_size", "target", "base", F.coalesce("cut", F.lit(0).cast("long")).alias("cut"), "fills"), "thresholds")


def copies(size: Column, h: Column) -> Column:
    """How often a document of a size and hash is taken, beside the thresholds of its source."""
    fills = F.coalesce(F.exists("fills", lambda f: (h >= f["low"]) & (h < f["high"]) & (size <= f["most"])), F.lit(False))
    return F.col("base") + F.when((h < F.col("cut")) | fills, 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Which documents a mix takes, and how often: doc_id, source, size, source_size, target, copies, taken.

    Sources in code-point order (null is a source, the last) weigh ``weights`` in turn and share the sum of
    all sizes; no target exceeds ``max_repeats`` times its source's size.  A null or blank text has size 0
    and a source of size 0 the target 0.  Rows that repeat an id share its hash, so they are taken
    together; null ids are hashed by text.  An empty table gives an empty table.  Further columns
    are ignored.
    """
    s = stage(slim(docs), "slim")
    taken = s.join(small(thresholds(s, weights, max_repeats)), "key").withColumn("copies", copies(F.col("size"), F.col("h")))
    return taken.select("doc_id", F.col("by").alias("source"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """The documents of the mix themselves, each as often as it is taken, with the columns of ``docs``."""
    t = small(thresholds(stage(slim(docs), "slim"), weights, max_repeats))
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    keyed = docs.select(row, key_of(docs["source"]).alias("key"), word_count(docs["text"]).alias("size"), document_hash(docs["doc_id"], docs["text"]).alias("h"))
    times = copies(F.col("size"), F.col("h")).cast("int")
    return keyed.join(t, "key").select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")
