"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

Documents are dealt by hash to groups of bounded expected size; each group is packed by itself, so no hot source or
family of copies lands in one task.  Within a group, bins are ordered by residual capacity and carry two
bitmaps: the sources and the duplicate clusters of what they hold.  A document goes to the bin with the
smallest residual that holds it and shares neither its source nor its cluster; the search goes on to the
next larger residual until such a bin is found, and opens a bin only if there is none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, stage
from .mixing import word_count
from .simhash import classes, key

CAPACITY, GROUP_ROWS = 2048, 4096


class Packer:
    """Best fit over bins ordered by residual; a document's conflicts are bits of small local codes."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.codes: tuple[dict, dict] = ({}, {})
        self.bins: list[list[int]] = []  # residual, source bitmap, cluster bitmap
        self.at: dict[int, dict[int, None]] = defaultdict(dict)  # residual -> its bins, oldest first
        self.open = 0  # bitmap of the residuals that have bins
        #: By conflict key: how many bins of a residual hold it, and the residuals where all of them do.
        self.holding: dict[tuple, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        self.full: dict[tuple, int] = defaultdict(int)
        self.full_at: dict[int, set] = defaultdict(set)
        self.held: list[list[tuple]] = []

    def bit(self, kind: int, value) -> int:
        """The bit of a source (0) or cluster (1); none for null, which conflicts with nothing."""
        return 0 if value is None else 1 << self.codes[kind].setdefault(value, len(self.codes[kind]))

    def _take(self, b: int) -> None:
        r = self.bins[b][0]
        del self.at[r][b]
        if not self.at[r]:
            self.open &= ~(1 << r)
        for k in self.held[b]:
            self.holding[k][r] -= 1

    def _put(self, b: int, r: int) -> None:
        self.bins[b][0] = r
        if not r:
            return
        self.at[r][b] = None
        self.open |= 1 << r
        for k in self.held[b]:
            self.holding[k][r] += 1
        for k in [k for k in self.full_at[r] if k not in self.held[b]]:
            self.full_at[r].discard(k)
            self.full[k] &= ~(1 << r)

    def add(self, size: int, source, cluster) -> tuple[int, int]:
        """Place a document; its bin and the offset in it."""
        s, c = self.bit(0, source), self.bit(1, cluster)
        keys = [(i, bit) for i, bit in enumerate((s, c)) if bit]
        left = self.open >> size
        for k in keys:
            left &= ~(self.full[k] >> size)
        found, r = None, size
        while left:
            step = (left & -left).bit_length() - 1
            left >>= step
            r += step
            found = next((b for b in self.at[r] if not (self.bins[b][1] & s or self.bins[b][2] & c)), None)
            if found is not None:
                break
            for k in keys:
                if self.holding[k][r] == len(self.at[r]):
                    self.full[k] |= 1 << r
                    self.full_at[r].add(k)
            left &= ~1
        if found is None:
            found, r = len(self.bins), self.capacity
            self.bins.append([r, 0, 0])
            self.held.append([])
        else:
            self._take(found)
        self.bins[found][1] |= s
        self.bins[found][2] |= c
        self.held[found] += keys
        self._put(found, r - size)
        return found, self.capacity - r


def pack_rows(rows: Iterable[tuple], capacity: int) -> list[tuple[int, int]]:
    """(size, source, cluster) in order -> (bin, offset)."""
    packer = Packer(capacity)
    return [packer.add(*x) for x in rows]


def near_copies(docs: DataFrame) -> DataFrame:
    """k, component: a row for each document, with its group of near copies by fingerprint."""
    return classes(docs.select(key(docs).alias("k"), docs["text"].alias("text"))).select("k", "component")


def pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, size=None, cluster=None, clusters: DataFrame | None = None) -> DataFrame:
    """doc_id, source, piece, start, size, bin_id, bin_offset: one row for each piece of each document.

    ``size`` and ``cluster`` are columns of ``docs``; by default the number of words (null text: 0) and a
    hash of the text, so that exact copies never share a bin.  ``clusters`` (k, component, as
    :func:`near_copies` gives them) names them by document instead; a null or blank text has none.  A document longer than ``capacity`` is cut into pieces
    of ``capacity``, which fill bins by themselves, and a rest that is packed; the pieces cover it whole.
    Two pieces of one source, or of one cluster, never share a bin; a null source or cluster conflicts
    with nothing.  A document of size 0 gets one piece of size 0 in no bin (null).  In a group, pieces go largest
    first, ties by id, text hash and source, so reruns agree; rows that repeat an id are packed each, and their
    full pieces have bins of their own.  An empty table gives an empty table.
    """
    text = docs["text"]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), (word_count(text) if size is None else F.coalesce(docs[size].cast("long"), F.lit(0).cast("long"))).alias("words"), (F.xxhash64(text) if cluster is None else docs[cluster].cast("long")).alias("cluster"), F.xxhash64(docs["doc_id"], text).alias("h"), text.isNull().alias("blank"), key(docs).alias("k"), F.coalesce(text.rlike(WORD), F.lit(False)).alias("some"))
    if clusters is not None:
        named = stage(clusters.groupBy("k").agg(F.min("component").alias("cluster")), "clusters")
        rows = stage(rows, "slim").drop("cluster").join(small(named), "k", "left").withColumn("cluster", F.when(F.col("some"), F.col("cluster")))
    rows = stage(rows.withColumn("cluster", F.when(~F.col("blank") if cluster is None else F.lit(True), F.col("cluster"))).drop("blank", "k", "some"), "sizes")
    n = max(1, -(-rows.count() // group_rows))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / capacity)))))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("size", F.least(F.col("words") - F.col("start"), F.lit(capacity).cast("long")))
    pieces = pieces.select("doc_id", "source", "piece", "start", "size", "cluster", "h", F.pmod("h", F.lit(n)).alias("g"))
    alike = ["doc_id", "source", "words", "h"]
    # repeats are counted before they are numbered, so a hot row is one row here
    long = rows.where(F.col("words") >= capacity).groupBy(*alike).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("h").orderBy("doc_id", "source", "words").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    long = long.withColumn("before", before).select(*alike, F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("copy"))
    long = long.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("words") / capacity) - 1)).alias("piece"))
    name = F.concat_ws("-", F.lit("full"), F.hex("h"), "copy", "piece")
    zero, filled = F.lit(0).cast("long"), F.lit(capacity).cast("long")
    full = long.select("doc_id", "source", "piece", (F.col("piece") * capacity).alias("start"), filled.alias("size"), name.alias("bin_id"), zero.alias("bin_offset"))
    empty = pieces.where("size = 0").select("doc_id", "source", "piece", "start", "size", F.lit(None).cast("string").alias("bin_id"), zero.alias("bin_offset"))

    order = [("size", "descending"), ("doc_id", "ascending"), ("h", "ascending"), ("piece", "ascending"), ("source", "ascending")]

    def one(group: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by(order)
        placed = pack_rows(zip(*(part[c].to_pylist() for c in ("size", "source", "cluster")), strict=True), capacity)
        bins = pa.array([f"{group[0].as_py()}-{b}" for b, _ in placed], pa.string()), pa.array([o for _, o in placed], pa.int64())
        return part.select(["doc_id", "source", "piece", "start", "size"]).append_column("bin_id", bins[0]).append_column("bin_offset", bins[1])

    packed = pieces.where((F.col("size") < capacity) & (F.col("size") > 0)).groupBy("g").applyInArrow(one, full.schema)
    return packed.unionByName(full).unionByName(empty)
