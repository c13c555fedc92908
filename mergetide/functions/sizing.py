"""Parameter sizing: plain Python on the driver, checked before any plan is built."""

from __future__ import annotations

import math
import warnings

from ..errors import open_fraction, positive, require, within


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def bloom_bits(items: int, rate: float) -> int:
    positive(items=items)
    open_fraction(rate=rate)
    return max(1, math.ceil(-items * math.log(rate) / math.log(2) ** 2))


def bloom_hashes(bits: int, items: int) -> int:
    positive(bits=bits, items=items)
    return max(1, _half_up(bits / items * math.log(2)))


def cuckoo_collision(bits: int) -> float:
    q = 2.0**bits
    return (q + 2) / q**2


def cuckoo_bound(bits: int) -> float:
    return min(1.0, 8 * cuckoo_collision(bits))


def cuckoo_buckets(items: int) -> int:
    positive(items=items)
    n = next_power_of_two(max(2, -(-items // 4)))
    return 2 * n if items / (4 * n) > 0.96 else n


def cuckoo_bits(rate: float) -> int:
    open_fraction(rate=rate)
    found = next((b for b in range(6, 17) if cuckoo_bound(b) <= rate), 0)
    require(found > 0, f"rate={rate!r} is out of reach of 16 bits")
    return found


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def hll_precision(p: int) -> int:
    within(4, 18, p=p)
    return p


def hll_error(p: int) -> float:
    return 1.04 / math.sqrt(1 << hll_precision(p))


def hll_for_error(target: float) -> int:
    open_fraction(target=target)
    found = next((p for p in range(4, 19) if hll_error(p) <= target), 0)
    require(found > 0, f"target={target!r} is out of reach of p=18")
    return found


# Variance factor and inverse Fisher information of the two estimators.
ULL_FACTORS = {"fgra": math.sqrt(0.6118931496978437), "mle": 0.7608621002725182}


def ull_precision(p: int) -> int:
    within(3, 26, p=p)
    return p


def ull_error(p: int, estimator: str = "fgra") -> float:
    return ULL_FACTORS[estimator] / math.sqrt(1 << ull_precision(p))


def ull_for_error(target: float, estimator: str = "fgra") -> int:
    open_fraction(target=target)
    found = next((p for p in range(3, 27) if ull_error(p, estimator) <= target), 0)
    require(found > 0, f"target={target!r} is out of reach of p=26")
    return found


def minhash_for_error(error: float) -> int:
    require(math.isfinite(error) and error > 0, f"error={error!r}, wanted: above 0")
    return max(1, math.ceil((0.5 / error) ** 2))


def minhash_worst_error(k: int) -> float:
    positive(k=k)
    return 0.5 / math.sqrt(k)


def minhash_error_at(k: int, jaccard: float) -> float:
    positive(k=k)
    within(0, 1, jaccard=jaccard)
    return math.sqrt(jaccard * (1 - jaccard) / k)


def minhash_expected_error(k: int) -> float:
    warnings.warn("use minhash_worst_error", DeprecationWarning, stacklevel=2)
    return minhash_worst_error(k)


def lsh_rows(hashes: int, bands: int) -> int:
    positive(hashes=hashes, bands=bands)
    require(hashes % bands == 0, f"{hashes} hashes can't be dealt to {bands} bands evenly")
    return hashes // bands


def lsh_probability(similarity: float, bands: int, rows: int) -> float:
    within(0, 1, similarity=similarity)
    band = similarity**rows
    return 1.0 if band == 1 else -math.expm1(bands * math.log1p(-band))


def lsh_similarity(probability: float, bands: int, rows: int) -> float:
    within(0, 1, probability=probability)
    return 1.0 if probability == 1 else (-math.expm1(math.log1p(-probability) / bands)) ** (1 / rows)


def count_min_size(epsilon: float, delta: float) -> tuple[int, int]:
    open_fraction(epsilon=epsilon, delta=delta)
    return next_power_of_two(math.ceil(math.e / epsilon)), max(1, math.ceil(-math.log(delta)))


LN_16_7 = math.log(16 / 7)


def count_sketch_size(epsilon: float, delta: float) -> tuple[int, int]:
    open_fraction(epsilon=epsilon, delta=delta)
    depth = max(1, math.ceil(2 * math.log(1 / delta) / LN_16_7))
    depth += depth % 2 == 0
    while math.exp(-depth * LN_16_7 / 2) > delta:
        depth += 2
    return next_power_of_two(math.ceil(8 / epsilon**2)), depth


def kll_rank_error(k: int, failure: float = 0.01) -> float:
    return math.sqrt(math.log(2 / failure) / (4 / 27)) / k


def kll_for_error(error: float, failure: float = 0.01) -> int:
    open_fraction(error=error, failure=failure)
    return max(2, math.ceil(kll_rank_error(1, failure) / error))


def tdigest_for_error(error: float) -> float:
    open_fraction(error=error)
    return float(max(10, math.ceil(10 / error)))
