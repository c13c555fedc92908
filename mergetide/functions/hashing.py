"""The 64-bit hash family, three times: as Catalyst columns, as Python and NumPy, and as text for a SQL engine.

Keys become 64-bit integers (integers by value, all else by the first 16 hexadecimal digits of the MD5 of its
string), and ``hash(key, seed)`` is SplitMix64 of the key xor the mixed seed.  Longs hold unsigned values by bit
pattern.  Products must wrap, so hash columns are built while ANSI arithmetic is off; expressions
keep the mode they were analysed under, and the session's setting is put back at once.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
MIN_LONG = -(1 << 63)

# Fixed values of SplitMix64.
INCREMENT, FACTOR_1, FACTOR_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

# Seeds of the families.
BLOOM_SEED_A, BLOOM_SEED_B = 0x243F6A8885A308D3, 0x13198A2E03707344
CUCKOO_ITEM_SEED, CUCKOO_RNG, CUCKOO_MIX = 0x243F6A8885A308D3, 0xD6E8FD935E7A4A6D, 0x5BD1E995
HLL_SEED, ULL_SEED = 0xD6E8FD935E7A4A6D, 0xA0761D6478BD642F
MINHASH_FAMILY = 0xBF58476D1CE4E5B9
COUNT_MIN_ROWS, COUNT_SKETCH_ROWS, MIN_MAX_ROWS = 0x510E527FADE682D1, 0xA4093822299F31D0, 0x3C6EF372FE94F82B
KLL_SEED, RESERVOIR_RNG = 0xD1B54A32C192ED03, 0x94D049BB133111EB


def signed(x: int) -> int:
    """The long with the bits of x."""
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def splitmix64(x: int) -> int:
    x = (x + INCREMENT) & MASK
    x = ((x ^ (x >> 30)) * FACTOR_1) & MASK
    x = ((x ^ (x >> 27)) * FACTOR_2) & MASK
    return x ^ (x >> 31)


def key_of(value) -> int:
    """The 64-bit key of a Python value."""
    if isinstance(value, (int, np.integer)) and not isinstance(value, bool):
        return int(value) & MASK
    return int(hashlib.md5(str(value).encode()).hexdigest()[:16], 16)


def hash64(value, seed: int) -> int:
    return splitmix64(key_of(value) ^ splitmix64(seed))


def seed_stream(seed: int) -> Iterator[int]:
    """Successive SplitMix64 outputs."""
    while True:
        yield splitmix64(seed)
        seed = (seed + INCREMENT) & MASK


def splitmix64_array(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(INCREMENT)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FACTOR_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(FACTOR_2)
    return x ^ (x >> np.uint64(31))


# columns


_building = threading.RLock()


@contextmanager
def wrapping(spark: SparkSession):
    """Arithmetic of expressions that are analysed inside wraps around.  One thread at a time, so that none puts back what another has set."""
    name = "spark.sql.ansi.enabled"
    with _building:
        before = spark.conf.get(name)
        spark.conf.set(name, "false")
        try:
            yield
        finally:
            spark.conf.set(name, before)


def long(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def key64(df: DataFrame, column: str) -> Column:
    """The 64-bit key of a column; null for null."""
    if dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint"):
        return F.col(column).cast("long")
    return F.conv(F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 16), 16, -10).cast("long")


def with_mix(df: DataFrame, out: str, x: Column) -> DataFrame:
    """Adds ``out``, SplitMix64 of ``x``.  Each step is a column of its own, as Catalyst would repeat what is used twice."""
    return with_mixes(df, {out: x})


def with_mixes(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """:func:`with_mix` of several columns side by side."""
    names = [(out, f"_{out}_a", f"_{out}_b") for out in columns]
    scrambled = lambda c, bits, factor: F.col(c).bitwiseXOR(F.shiftrightunsigned(c, bits)) * long(factor)
    with wrapping(df.sparkSession):
        df = df.withColumns({a: columns[out] + long(INCREMENT) for out, a, _ in names})
        df = df.withColumns({b: scrambled(a, 30, FACTOR_1) for _, a, b in names})
        df = df.withColumns({a: scrambled(b, 27, FACTOR_2) for _, a, b in names})
        df = df.withColumns({out: F.col(a).bitwiseXOR(F.shiftrightunsigned(a, 31)) for out, a, _ in names})
    return df.drop(*(x for _, a, b in names for x in (a, b)))


def with_hash(df: DataFrame, out: str, column: str, seed: int) -> DataFrame:
    return with_mix(df, out, key64(df, column).bitwiseXOR(long(splitmix64(seed))))


def unsigned(x: Column) -> Column:
    """A long in whose signed order the unsigned order of ``x`` lies; its own inverse."""
    return x.bitwiseXOR(F.lit(MIN_LONG))


def unsigned_mod(x: Column, m: int) -> Column:
    if m & (m - 1) == 0:
        return x.bitwiseAND(F.lit(m - 1).cast("long"))
    m_ = F.lit(m).cast("long")
    return F.pmod((F.shiftrightunsigned(x, 1) % m_) * 2 + x.bitwiseAND(F.lit(1).cast("long")), m_)


def scaled(x: Column, width: int) -> Column:
    """The high word of the product of ``x`` and a width below 2**31."""
    w = F.lit(width).cast("long")
    low = F.shiftrightunsigned(x.bitwiseAND(long(0xFFFFFFFF)) * w, 32)
    return F.shiftrightunsigned(F.shiftrightunsigned(x, 32) * w + low, 32)


def leading_zeros(x: Column) -> Column:
    return F.when(x == 0, F.lit(64)).otherwise(F.lit(64) - F.length(F.bin(x)))


def with_multiply_shift(df: DataFrame, out: str, x: str, a: Column, b: Column, bits: int) -> DataFrame:
    """Adds the top ``bits`` of ``(a * x + b) mod 2**(63 + bits)``; ``a`` and ``b`` are structs of longs (hi, lo).

    The 128-bit product is put together from 32-bit limbs.
    """
    if not bits:
        return df.withColumn(out, F.lit(0).cast("long"))
    low = long(0xFFFFFFFF)
    c = lambda n: F.col(f"_{out}_{n}")
    steps = {
        "a1": lambda: F.shiftrightunsigned(a["lo"], 32), "a0": lambda: a["lo"].bitwiseAND(low), "x1": lambda: F.shiftrightunsigned(x, 32), "x0": lambda: F.col(x).bitwiseAND(low),
        "t": lambda: c("a0") * c("x0"), "u": lambda: c("a1") * c("x0") + F.shiftrightunsigned(c("t"), 32), "v": lambda: c("a0") * c("x1") + c("u").bitwiseAND(low),
        "hi": lambda: c("a1") * c("x1") + F.shiftrightunsigned(c("u"), 32) + F.shiftrightunsigned(c("v"), 32), "lo": lambda: a["lo"] * F.col(x) + b["lo"],
        "h": lambda: c("hi") + a["hi"] * F.col(x) + b["hi"] + F.when(unsigned(c("lo")) < unsigned(b["lo"]), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")),
    }
    with wrapping(df.sparkSession):
        for n, step in steps.items():
            df = df.withColumn(f"_{out}_{n}", step())
        df = df.withColumn(out, F.shiftleft(c("h"), 1).bitwiseOR(F.shiftrightunsigned(c("lo"), 63)).bitwiseAND(long((1 << bits) - 1)))
    return df.drop(*(f"_{out}_{n}" for n in steps))


# the same in a SQL engine with unsigned types


def sql_key(x: str, text: bool = False) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 16) AS UBIGINT)" if text else f"CAST({x} AS UBIGINT)"


def _sql_times(x: str, c: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {c}) % 18446744073709551616 AS UBIGINT)"


def sql_mix(x: str) -> str:
    x = f"CAST((CAST({x} AS UHUGEINT) + {INCREMENT}) % 18446744073709551616 AS UBIGINT)"
    x = _sql_times(f"xor({x}, {x} >> 30)", FACTOR_1)
    x = _sql_times(f"xor({x}, {x} >> 27)", FACTOR_2)
    return f"xor({x}, {x} >> 31)"


def sql_hash(x: str, seed: int, text: bool = False) -> str:
    return sql_mix(f"xor({sql_key(x, text)}, CAST({splitmix64(seed)} AS UBIGINT))")


def sql_signed(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN CAST({x} AS HUGEINT) - 18446744073709551616 ELSE CAST({x} AS HUGEINT) END AS BIGINT)"


def sql_multiply_shift(x: str, a: int, b: int, bits: int) -> str:
    """``a`` and ``b`` below 2**(63 + bits); the product is taken modulo 2**(63 + bits) limb by limb."""
    if not bits:
        return "0"
    n = 63 + bits
    hi, lo = f"CAST({x} >> 32 AS UHUGEINT)", f"CAST({x} & 4294967295 AS UHUGEINT)"
    a_, b_ = f"CAST('{a % (1 << (n - 32))}' AS UHUGEINT)", f"CAST('{b}' AS UHUGEINT)"
    whole, half = f"CAST('{1 << n}' AS UHUGEINT)", f"CAST('{1 << (n - 32)}' AS UHUGEINT)"
    return f"CAST((((CAST('{a}' AS UHUGEINT) * {lo}) % {whole} + (({a_} * {hi}) % {half}) * 4294967296 + {b_}) % {whole}) // CAST('{1 << 63}' AS UHUGEINT) AS BIGINT)"


# SipHash-1-3, the family of the golden values


def _sip_round(v: list) -> None:
    rot = lambda x, b: (x << np.uint64(b)) | (x >> np.uint64(64 - b))
    v[0] = v[0] + v[1]
    v[2] = v[2] + v[3]
    v[1] = rot(v[1], 13) ^ v[0]
    v[3] = rot(v[3], 16) ^ v[2]
    v[0] = rot(v[0], 32)
    v[2] = v[2] + v[1]
    v[0] = v[0] + v[3]
    v[1] = rot(v[1], 17) ^ v[2]
    v[3] = rot(v[3], 21) ^ v[0]
    v[2] = rot(v[2], 32)


def sip13(words: list, length: int, keys: tuple[int, int] = (0, 0)) -> np.ndarray:
    """SipHash-1-3 of messages of ``length`` bytes (a multiple of 8), given as arrays of their little-endian words."""
    with np.errstate(over="ignore"):
        k0, k1 = np.uint64(keys[0]), np.uint64(keys[1])
        v = [k0 ^ np.uint64(0x736F6D6570736575), k1 ^ np.uint64(0x646F72616E646F6D), k0 ^ np.uint64(0x6C7967656E657261), k1 ^ np.uint64(0x7465646279746573)]
        for m in [*words, np.uint64((length & 255) << 56)]:
            v[3] = v[3] ^ m
            _sip_round(v)
            v[0] = v[0] ^ m
        v[2] = v[2] ^ np.uint64(255)
        for _ in range(3):
            _sip_round(v)
        return v[0] ^ v[1] ^ v[2] ^ v[3]


def seeded_sip13(keys: np.ndarray, seed: int) -> np.ndarray:
    """The seeded hash of 64-bit keys: SipHash-1-3 of the seed and the key."""
    return sip13([np.uint64(seed), keys.astype(np.uint64)], 16)
