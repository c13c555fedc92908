"""SimHash near-duplicates through an inverted index of positional bytes with count filtering.

Fingerprints that differ in at most two bits agree in at least six of their eight bytes.  The index lists
fingerprints by four positional bytes at a time, in 14 blocks of which any three positions lie in exactly
one.  So whoever shares six or more positional bytes meets in blocks that cover them all, and whoever
shares five meets once: the union of the blocks in which a pair meets tallies its shared bytes, pairs
with fewer than six are dropped, and the others are verified bit by bit.

A list of more than ``LONG_LIST`` fingerprints (a large family of near copies) is not paired off.  There each
fingerprint is listed under itself and its 64 one-bit variants: two fingerprints are within two bits
exactly if they share a variant, and a variant has at most 65 of them, so links to the smallest suffice.
A pair that meets in any long list is linked there, and one that meets in none has its whole tally.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, slices, small, stage

MAX_BITS, MIN_BYTES, LONG_LIST = 2, 6, 32
#: The planes of a space of eight points: sets of four positions whose numbers cancel out.
BLOCKS = [x for x in combinations(range(8), 4) if not x[0] ^ x[1] ^ x[2] ^ x[3]]
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, words_per_shingle: int = 3) -> int:
    """SimHash of one text, as a signed 64-bit integer; 0 without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        words = [b" ".join(words)]
    else:
        words = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in words], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _batches(batches, words_per_shingle):
    for b in slices(batches):
        texts = b.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, words_per_shingle) for t in texts], pa.int64())], names=["k", "fp"])


def fingerprints(keyed: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """``keyed``: columns k (long), text -> k, fp."""
    return keyed.select("k", "text").mapInArrow(lambda it: _batches(it, words_per_shingle), "k long, fp long")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fps`` (fp, staged) that join all those within two bits."""
    masks = [sum(255 << 8 * i for i in block) for block in BLOCKS]
    parts = F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) * (m >> 63))) for m in masks])
    postings = fps.select("fp", F.posexplode(parts).alias("block", "part"))
    lengths = stage(postings.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lengths")
    lists = stage(postings.join(lengths, ["block", "part"]), "lists")
    short = lists.where(F.col("n") <= LONG_LIST)
    a, b = short.select("block", "part", F.col("fp").alias("a")), short.select("block", "part", F.col("fp").alias("b"))
    covered = F.get(F.array(*[F.lit(sum(1 << i for i in block)) for block in BLOCKS]), F.col("block"))
    tallied = a.join(b, ["block", "part"]).where("a < b").groupBy("a", "b").agg(F.bit_count(F.bit_or(covered)).alias("shared"))
    pairs = tallied.where(F.col("shared") >= MIN_BYTES).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    long = lists.where(F.col("n") > LONG_LIST).select("fp").distinct()
    flips = [F.lit(0), *[F.lit((1 << i) - (1 << 64) * (i == 63)) for i in range(64)]]
    long = long.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("variant"))
    least = long.groupBy("variant").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.union(long.join(least, "variant").where("fp <> b").select(F.col("fp").alias("a"), "b")).distinct()


def classes(keyed: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """``keyed``: columns k (long, not null), text -> k, fp, component: the smallest k reachable by links.

    A row for each input row.  A null text and one without words have the fingerprint 0.
    """
    rows = stage(fingerprints(keyed, words_per_shingle), "fingerprints")
    reps = stage(rows.groupBy("fp").agg(F.min("k").alias("rep")), "classes")
    comps = stage(connected_components(fingerprint_links(reps.select("fp"))), "components")
    linked = reps.join(comps, reps["fp"] == comps["node"], "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp"))
    least = linked.groupBy("comp").agg(F.min("rep").alias("component"))
    named = stage(linked.join(least, "comp").select("fp", "component"), "named")
    return rows.join(named, "fp").select("k", "fp", "component")


def key(docs: DataFrame):
    """The id, or where it is null a hash of the text that lies above all ids below 2**62."""
    return F.coalesce(docs["doc_id"].cast("long"), F.shiftrightunsigned(F.xxhash64(docs["text"]), 2).bitwiseOR(F.lit(1 << 62)))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept (long, string, long, boolean): a row for each row.

    Rows with the same id are one document for the component; a row without id keeps a null id, takes
    part in the links, and its component is null only if no member has an id.  Null and blank texts have
    the fingerprint zero and are linked with each other.  An empty table gives an empty table.
    """
    got = classes(docs.select(key(docs).alias("k"), docs["text"].alias("text")), words_per_shingle)
    named = lambda c: F.when(F.col(c) < (1 << 62), F.col(c))
    return got.select(named("k").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), named("component").alias("component_id"), (F.col("k") == F.col("component")).alias("kept"))


def deduplicated(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """One document of each group, with the columns of ``docs``; of rows that repeat an id one stays."""
    keyed = docs.withColumn("_mt_k", key(docs))
    got = stage(classes(keyed.select(F.col("_mt_k").alias("k"), docs["text"].alias("text")), words_per_shingle), "groups")
    repeated = stage(got.where("k = component").groupBy("k").count().where("count > 1").select(F.col("k").alias("_mt_k")), "repeated")
    gone = stage(got.where("k <> component").select(F.col("k").alias("_mt_k")).distinct(), "gone")
    kept = keyed.join(small(gone), "_mt_k", "left_anti")
    if repeated.limit(1).count():
        once = small(repeated)
        kept = kept.join(once, "_mt_k", "left_anti").unionByName(kept.join(once, "_mt_k", "left_semi").dropDuplicates(["_mt_k"]))
    return kept.select(*docs.columns)
