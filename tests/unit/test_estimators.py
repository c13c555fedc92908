import math

import numpy as np

from mergetide.functions import estimators as E
from mergetide.functions import hashing as H


def vector(counts, q=56):
    return [counts.get(i, 0) for i in range(q + 2)]


def pack(x):
    if not x:
        return 0
    top = x.bit_length() - 1
    return 4 * top + (x << 2 >> top & 3)


def ull_state(p, n, seed=0x0123456789ABCDEF):
    prefix = [0] * (1 << p)
    for i in range(n):
        h = H.splitmix64((seed + i) & H.MASK)
        s = h & ((1 << (64 - p)) - 1)
        prefix[h >> (64 - p)] |= 1 << (63 - s.bit_length())
    return bytes(map(pack, prefix))


def test_hll_known_vectors():
    for counts, want in (({0: 80, 1: 70, 2: 50, 3: 30, 4: 20, 5: 6}, 286.86662598676315), ({1: 5, 2: 40, 3: 70, 4: 80, 5: 50, 8: 11}, 1675.8944054878602), ({40: 5, 45: 40, 50: 70, 55: 80, 56: 50, 57: 11}, 10290268119670374)):
        assert abs(E.hll(vector(counts)) / want - 1) < 1e-13
    assert E.hll(vector({0: 256})) == 0 and E.hll(vector({57: 256})) == math.inf


def test_ull_known_states():
    assert ull_state(3, 20).hex() == "0e08151114130e00"
    for p, n, fgra, mle in ((3, 20, 19.76709376935443, 20.790678259670717), (6, 1000, 1053.0275330505897, 1039.5316200247576)):
        h = E.registers_histogram(ull_state(p, n))
        assert abs(E.ull_fgra(h, p) / fgra - 1) < 2e-15 and abs(E.ull_mle(h, p) / mle - 1) < 2e-15


def test_ull_boundaries():
    empty, full = [8] + [0] * 255, [0] * 255 + [8]
    assert E.ull_fgra(empty, 3) == 0 and E.ull_mle(empty, 3) == 0 and E.ull_fgra(full, 3) == math.inf and E.ull_mle(full, 3) == math.inf
    some = [0] * 256
    some[250], some[252], some[254] = 5, 1, 2
    assert 1e18 < E.ull_fgra(some, 3) < 1e20


def test_errors_are_as_stated():
    rng = np.random.default_rng(1)
    p, n, hll, fgra, mle = 9, 5000, [], [], []
    for _ in range(40):
        h = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        idx, s = h >> np.uint64(64 - p), h & np.uint64((1 << (64 - p)) - 1)
        length = np.array([int(x).bit_length() for x in s])
        ranks = np.zeros(1 << p, int)
        np.maximum.at(ranks, idx, 64 - p - length + 1)
        hll.append(E.hll(np.bincount(ranks, minlength=64 - p + 2).tolist()) / n - 1)
        prefix = np.zeros(1 << p, np.uint64)
        np.bitwise_or.at(prefix, idx, np.uint64(1) << (63 - length).astype(np.uint64))
        hist = E.registers_histogram(bytes(pack(int(x)) for x in prefix))
        fgra.append(E.ull_fgra(hist, p) / n - 1)
        mle.append(E.ull_mle(hist, p) / n - 1)
    root = math.sqrt(1 << p)
    for errors, factor in ((hll, 1.04), (fgra, 0.78224), (mle, 0.76086)):
        assert abs(np.mean(errors)) < 4 * factor / root / math.sqrt(40) and 0.6 < np.std(errors) * root / factor < 1.4
