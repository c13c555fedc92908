"""Cuckoo filters in count form, and a kernel with the literal placement.

A fingerprint always lies in one of its two buckets, and the two are given by either one, so membership depends only
on how many copies of a fingerprint each bucket pair holds, not on where kicks have moved them.  The count form
keeps ``(fp, pair, n)``: it is built by grouping, merged by adding, and deleted from by subtracting.  Only
refused insertions depend on placement; :class:`Kernel` reproduces them, one table at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..errors import positive, power_of_two, require, within
from ..functions import hashing as H
from ..functions import sizing
from . import marks

SLOTS, MAX_KICKS, MAX_LOAD = 4, 500, 0.96
#: Refused places that a table remembers until it changes; beyond it they are tried again.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Cuckoo:
    buckets: int
    bits: int
    max_kicks: int = MAX_KICKS

    def __post_init__(self):
        power_of_two(buckets=self.buckets)
        within(6, 16, bits=self.bits)
        positive(max_kicks=self.max_kicks)

    @classmethod
    def for_items(cls, items: int, rate: float) -> Cuckoo:
        return cls(sizing.cuckoo_buckets(items), sizing.cuckoo_bits(rate))

    @property
    def expected_false_positive_rate(self) -> float:
        return sizing.cuckoo_bound(self.bits)

    def place(self, hash_: int) -> tuple[int, int, int]:
        """Fingerprint and the two buckets of a hash."""
        fp = max(1, hash_ & ((1 << self.bits) - 1))
        first = (hash_ >> self.bits) & (self.buckets - 1)
        return fp, first, self.other(first, fp)

    def other(self, bucket: int, fp: int) -> int:
        return (bucket ^ fp * H.CUCKOO_MIX) & (self.buckets - 1)

    def with_place(self, df: DataFrame, key: str) -> DataFrame:
        """Adds ``fp`` and ``pair``, the smaller of the two buckets."""
        df = H.with_hash(df, "_h", key, H.CUCKOO_ITEM_SEED)
        mask = F.lit(self.buckets - 1).cast("long")
        df = df.withColumn("fp", F.greatest(F.col("_h").bitwiseAND(F.lit((1 << self.bits) - 1).cast("long")), F.when(F.col("_h").isNotNull(), F.lit(1).cast("long"))))
        df = df.withColumn("_i", F.shiftrightunsigned("_h", self.bits).bitwiseAND(mask))
        return df.withColumn("pair", F.least("_i", F.col("_i").bitwiseXOR(F.col("fp") * F.lit(H.CUCKOO_MIX).cast("long")).bitwiseAND(mask))).drop("_h", "_i")

    def build(self, df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
        """by..., fp, pair, n.  Every row is an insertion; null keys are skipped."""
        placed = self.with_place(df.select(*by, key).where(F.col(key).isNotNull()), key)
        return self._marked(placed.groupBy(*by, "fp", "pair").agg(F.count(F.lit(1)).alias("n")))

    def _marked(self, state: DataFrame) -> DataFrame:
        return marks.mark(state, "fp", buckets=self.buckets, bits=self.bits)

    def _own(self, state: DataFrame) -> DataFrame:
        return marks.check(state, "fp", buckets=self.buckets, bits=self.bits)

    def insert(self, df: DataFrame, key: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
        """The rows of ``df`` with a key, and ``accepted``: whether a table of this size, which takes them in ``order``, has room.

        Placement depends on all insertions before, so a table is one task's work; the tables of ``by`` run side by
        side.  A task streams its rows and holds one table, whatever the number of rows; a full table refuses whole batches.
        """
        spec, columns = self, df.columns
        rows = df.where(F.col(key).isNotNull())
        rows = H.with_hash(rows, "_h", key, H.CUCKOO_ITEM_SEED)
        rows = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*by, *order)

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, of = Kernel(spec), None
            for batch in batches:
                if not (n := batch.num_rows):
                    continue
                keys, accepted, at = [batch.column(c) for c in by], np.zeros(n, bool), 0
                hashes = batch.column("_h").to_numpy(zero_copy_only=False).view(np.uint64)
                name = lambda i: tuple(math.nan if (x := k[i].as_py()) != x else x for k in keys)  # noqa: B023, E731
                ends = name(0), name(n - 1)
                for group, run in groupby([ends[0]] * n if ends[0] == ends[1] else map(name, range(n))):
                    begin, at = at, at + len(list(run))
                    if of is not None and group != of:
                        table = Kernel(spec)
                    of = group
                    for i, h in enumerate([] if table.full else hashes[begin:at].tolist(), begin):
                        accepted[i] = table.insert(h)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(accepted)], names=[*columns, "accepted"])

        return rows.select(*columns, "_h").mapInArrow(fill, StructType([*df.schema, StructField("accepted", BooleanType())]))

    def load(self, state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """by..., inserted, load_factor, overfull: overfull pairs hold more than their buckets can."""
        room = F.when((F.col("pair").bitwiseXOR(F.col("fp") * F.lit(H.CUCKOO_MIX).cast("long"))).bitwiseAND(F.lit(self.buckets - 1).cast("long")) == F.col("pair"), SLOTS).otherwise(2 * SLOTS)
        return state.groupBy(*by).agg(F.sum("n").alias("inserted"), (F.sum("n") / F.lit(float(SLOTS * self.buckets))).alias("load_factor"), F.count(F.when(F.col("n") > room, 1)).alias("overfull"))

    def probe(self, df: DataFrame, key: str, state: DataFrame, out: str = "maybe") -> DataFrame:
        self._own(state)
        placed = self.with_place(df, key)
        hit = state.where("n > 0").select(F.col("fp").alias("_fp"), F.col("pair").alias("_pair"), F.lit(True).alias("_hit"))
        joined = placed.join(hit, (F.col("fp") == F.col("_fp")) & (F.col("pair") == F.col("_pair")), "left")
        return joined.withColumn(out, F.when(F.col(key).isNotNull(), F.coalesce("_hit", F.lit(False)))).drop("fp", "pair", "_fp", "_pair", "_hit")

    @staticmethod
    def merge(*states: DataFrame) -> DataFrame:
        out = marks.union(states, "fp")
        return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))

    def delete(self, state: DataFrame, df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
        """Take away one copy for each row of ``df``, as far as there are any."""
        self._own(state)
        gone = self.build(df, key, by).withColumn("n", -F.col("n"))
        return self.merge(state, gone).where("n > 0")


class Kernel:
    """One table with four slots a bucket, random kicks, and refused insertions that leave it unchanged.

    As a refusal puts back the table and the random numbers, the same place is refused until the table changes, and a
    full table refuses all: neither takes kicks again.
    """

    def __init__(self, spec: Cuckoo):
        self.spec, self.table, self.inserted, self.rng = spec, [[0] * SLOTS for _ in range(spec.buckets)], 0, H.CUCKOO_RNG
        self.refused: set[tuple[int, int]] = set()

    @property
    def full(self) -> bool:
        return self.inserted == SLOTS * self.spec.buckets

    def _random(self) -> int:
        self.rng = H.splitmix64((self.rng + H.INCREMENT) & H.MASK)
        return self.rng

    def _put(self, bucket: int, fp: int) -> bool:
        slots = self.table[bucket]
        if 0 not in slots:
            return False
        slots[slots.index(0)] = fp
        self.inserted += 1
        self.refused.clear()
        return True

    def insert(self, hash_: int) -> bool:
        if self.full:
            return False
        place = fp, a, b = self.spec.place(hash_)
        if place[:2] in self.refused:
            return False
        if self._put(a, fp) or self._put(b, fp):
            return True
        before, moved = self.rng, []
        at = b if self._random() & 1 else a
        for _ in range(self.spec.max_kicks):
            slot = self._random() % SLOTS
            moved.append((at, slot, self.table[at][slot]))
            self.table[at][slot], fp = fp, self.table[at][slot]
            at = self.spec.other(at, fp)
            if self._put(at, fp):
                return True
        for bucket, slot, old in reversed(moved):
            self.table[bucket][slot] = old
        self.rng = before
        if len(self.refused) >= REMEMBERED:
            self.refused.clear()
        self.refused.add(place[:2])
        return False

    def contains(self, hash_: int) -> bool:
        fp, a, b = self.spec.place(hash_)
        return fp in self.table[a] or fp in self.table[b]

    def delete(self, hash_: int) -> bool:
        fp, a, b = self.spec.place(hash_)
        for i in (a, b):
            if fp in self.table[i]:
                self.table[i][self.table[i].index(fp)] = 0
                self.inserted -= 1
                self.refused.clear()
                return True
        return False

    def clear(self) -> None:
        self.table, self.inserted = [[0] * SLOTS for _ in range(self.spec.buckets)], 0
        self.refused.clear()

    def pack(self) -> bytes:
        """The table with ``bits`` for a slot, buckets at byte edges, little endian."""
        size, bits = -(-SLOTS * self.spec.bits // 8), self.spec.bits
        return b"".join(sum(fp << bits * i for i, fp in enumerate(b)).to_bytes(size, "little") for b in self.table)

    def unpack(self, data: bytes) -> None:
        size, bits = -(-SLOTS * self.spec.bits // 8), self.spec.bits
        require(len(data) == size * self.spec.buckets, f"{len(data)} bytes of a packed table, wanted: {size * self.spec.buckets}")
        words = [int.from_bytes(data[i : i + size], "little") for i in range(0, len(data), size)]
        self.table = [[w >> bits * i & ((1 << bits) - 1) for i in range(SLOTS)] for w in words]
        self.inserted = sum(x > 0 for b in self.table for x in b)
        self.refused.clear()

    @property
    def load_factor(self) -> float:
        return self.inserted / (SLOTS * self.spec.buckets)
