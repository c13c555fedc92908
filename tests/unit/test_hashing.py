import duckdb
import numpy as np
from pyspark.sql import functions as F

from mergetide.functions import hashing as H

XS = [0, 1, 2, 12345, (1 << 63) - 1, -1, -(1 << 63), -7, 0x0123456789ABCDEF]


def longs(spark):
    return spark.createDataFrame([(x,) for x in XS], "x long")


def test_splitmix_everywhere(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    got = {r.x: r.h for r in H.with_mix(longs(spark), "h", F.col("x")).collect()}
    assert spark.conf.get("spark.sql.ansi.enabled") == before
    arrays = H.splitmix64_array(np.array(XS, np.int64).view(np.uint64))
    for i, x in enumerate(XS):
        h = H.splitmix64(x & H.MASK)
        assert H.signed(h) == got[x] and int(arrays[i]) == h
        assert duckdb.sql(f"SELECT {H.sql_mix(f'CAST({x & H.MASK} AS UBIGINT)')}").fetchall()[0][0] == h


def test_minhash_golden():
    """Known signature of 0..9999 under seeded SipHash-1-3."""
    want = [751021725051808, 2594915795371041, 1524705651004105, 2787610102987, 3166387023764429, 1730634328335802, 4346437160029285, 304615318525070]
    keys = np.arange(10_000, dtype=np.uint64)
    assert [int(H.seeded_sip13(keys, H.splitmix64((i + H.MINHASH_FAMILY) & H.MASK)).min()) for i in range(8)] == want


def test_strings_and_numbers(spark):
    df = spark.createDataFrame([("alice", 5), ("é", 5), (None, None)], "s string, i int")
    rows = H.with_hash(H.with_hash(df, "a", "s", 1), "b", "i", 1).collect()
    assert [r.a for r in rows] == [H.signed(H.hash64("alice", 1)), H.signed(H.hash64("é", 1)), None]
    assert rows[0].b == H.signed(H.hash64(5, 1)) and rows[2].b is None


def test_unsigned_columns(spark):
    df = longs(spark).select("x", *(H.unsigned_mod(F.col("x"), m).alias(f"m{m}") for m in (64, 95851, 9586)), H.leading_zeros(F.col("x")).alias("z"), H.scaled(F.col("x"), 1009).alias("w"))
    for r in df.collect():
        u = r.x & H.MASK
        assert (r.m64, r.m95851, r.m9586) == (u % 64, u % 95851, u % 9586) and r.z == 64 - u.bit_length() and r.w == u * 1009 >> 64


def test_multiply_shift(spark):
    stream = H.seed_stream(3)
    for bits in (0, 1, 9, 12, 30):
        mask = (1 << (63 + bits)) - 1
        a, b = ((next(stream) << 64 | next(stream)) & mask for _ in range(2))
        pair = lambda v: F.struct(H.long(v >> 64).alias("hi"), H.long(v & H.MASK).alias("lo"))
        got = {r.x: r.c for r in H.with_multiply_shift(longs(spark), "c", "x", pair(a), pair(b), bits).collect()}
        for x in XS:
            want = ((a * (x & H.MASK) + b) & mask) >> 63 if bits else 0
            assert got[x] == want
            if bits and x >= 0:
                assert duckdb.sql(f"SELECT {H.sql_multiply_shift(f'CAST({x} AS UBIGINT)', a, b, bits)}").fetchall()[0][0] == want
