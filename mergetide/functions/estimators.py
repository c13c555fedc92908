"""Cardinality estimators on register histograms, which are tiny whatever the input was.

HyperLogLog: Ertl's maximum likelihood on the counts of register values.  UltraLogLog: the optimal
further-generalised remaining-area estimator (FGRA) and bias-reduced maximum likelihood, both on the counts of the
256 register bytes.
"""

from __future__ import annotations

import math

import numpy as np

# Fixed values of the UltraLogLog estimators.
TAU, VARIANCE = 0.8194911375910897, 0.6118931496978437
ETA = (4.663135422063788, 2.1378502137958524, 2.781144650979996, 0.9824082545153715)
BIAS, INVERSE_FISHER = 0.48147376527720065, 0.7608621002725182

_X = ETA[0] - ETA[1] - ETA[2] + ETA[3]
_PSI = ((ETA[2] - ETA[3]) / _X, (ETA[1] - ETA[3]) / _X, (ETA[3] * ETA[0] - ETA[1] * ETA[2]) / _X**2)
_2T, _4T = 2.0**-TAU, 4.0**-TAU


def _root(a: float, counts: list[float], low: int, bound: float, goal: float, tolerance: float) -> float:
    """Positive x with ``a*x + sum(counts[i] * h(x / 2**(low + i))) == goal``, where h(y) = 1 - y / (e**y - 1).

    ``h`` starts from its series at a small argument 2y and is doubled: h(4y) = (2y + h(1 - h)) / (2y + 1 - h) with y
    counted in halves.  Secant steps from a start below, given by ``bound``, stop at the tolerance or when
    rounding breaks their order.
    """
    high = low + len(counts) - 1
    x = goal / (bound / 2 + a) if bound <= 1.5 * a else goal / bound * math.log1p(bound / a)
    step, before = x, 0.0
    while step > x * tolerance:
        scale = max(high + 1, math.frexp(x)[1] + 2)
        y = math.ldexp(x, -scale)
        h = y - y * y / 3 + (y * y) ** 2 * (1 / 45 - y * y / 472.5)
        total = 0.0
        for at in range(scale - 1, low - 1, -1):
            if at <= high:
                total += counts[at - low] * h
            h, y = (y + h * (1 - h)) / (y + 1 - h), 2 * y
        total += a * x
        step = step * (goal - total) / (total - before) if before < total <= goal else 0.0
        x, before = x + step, total
    return x


def hll(counts: list[int]) -> float:
    """Estimate from the numbers of registers with value 0, 1, ..., q + 1 (q = 64 - precision)."""
    m, q = sum(counts), len(counts) - 2
    if counts[-1] == m:
        return math.inf
    if counts[0] == m:
        return 0.0
    # registers at the top value q + 1 saw at least 2**-q, like those at q would one step on
    inner = [float(c) for c in counts[1 : q + 1]]
    a = counts[0] + math.fsum(c * 2.0**-k for k, c in enumerate(inner, 1))
    inner[-1] += counts[-1]
    bound = math.fsum(c * 2.0**-k for k, c in enumerate(inner, 1))
    used = [i for i, c in enumerate(inner) if c]
    return m * _root(a, inner[used[0] : used[-1] + 1], used[0] + 1, bound, m - counts[0], 0.01 / math.sqrt(m))


def _psi(z: float, square: float) -> float:
    return (z + _PSI[0]) * (square + _PSI[1]) + _PSI[2]


def _sigma(z: float) -> float:
    if z <= 0:
        return ETA[3]
    if z >= 1:
        return math.inf
    total, weight, p = 0.0, _X, z
    while True:
        square = p * p
        new = total + weight * (p - square) * _psi(square, square * square)
        if new <= total:
            return new / z
        total, weight, p = new, weight * 2.0**TAU, square


def _phi(z: float, square: float) -> float:
    if z <= 0:
        return 0.0
    if z >= 1:
        return ETA[0] / (2.0**TAU * (2 * 2.0**TAU - 1))
    root = math.sqrt(z)
    weight = _X * _4T / (2 - _2T) / (1 + root)
    psi = _psi(z, square)
    total = root * 2 * psi * weight
    while True:
        z, root = root, math.sqrt(root)
        next_psi = _psi(z, z * z)
        weight *= _2T / (1 + root)
        new = total + root * (2 * next_psi - (z + root) * psi) * weight
        if new <= total:
            return new
        total, psi = new, next_psi


def _quadratic(a: float, b: float, c: float) -> float:
    return (math.sqrt(b * b + 4 * a * c) - b) / (2 * a)


def ull_fgra(histogram: list[int], p: int) -> float:
    """Estimate from the numbers of registers with byte 0, ..., 255."""
    m, edge = 1 << p, 4 * p + 4
    h = [int(x) for x in histogram]
    low = [sum(h[: edge - 8]), h[edge - 8], h[edge - 4], h[edge - 2]]
    top = h[252:]
    total = math.fsum(h[r] * ETA[(r - edge) & 3] * 2.0 ** (-TAU * (3 + (r - edge) // 4)) for r in range(edge, 252))
    if any(low):
        z = _quadratic(m + 3 * sum(low), m - low[0] - low[1], 4 * low[0] + 2 * low[1] + 3 * low[2] + low[3]) ** 4
        total += low[0] * _sigma(z) if low[0] else 0.0
        total += low[1] * _2T * _X * _psi(z, z * z)
        total += _4T * (low[2] * (z * (ETA[0] - ETA[1]) + ETA[1]) + low[3] * (z * (ETA[2] - ETA[3]) + ETA[3]))
    if any(top):
        z = math.sqrt(_quadratic(m + 3 * sum(top), top[0] + top[1] + 2 * (top[2] + top[3]), m + 2 * top[0] + top[2] - top[3]))
        root = math.sqrt(z)
        upper = _phi(root, z) * sum(top) + z * (1 + root) * sum(c * e for c, e in zip(top, ETA, strict=True))
        upper += root * _2T * ((top[0] + top[1]) * (z * (ETA[0] - ETA[2]) + ETA[2]) + (top[2] + top[3]) * (z * (ETA[1] - ETA[3]) + ETA[3]))
        total += upper * _2T ** (65 - p) / ((1 + root) * (1 + z))
    if total == math.inf:
        return 0.0
    if total == 0:
        return math.inf
    correction = 1 + VARIANCE * (1 + TAU) / (2 * m)
    return m * (m / total) ** (1 / TAU) / correction


def ull_mle(histogram: list[int], p: int) -> float:
    """Bias-reduced maximum likelihood from the numbers of registers with byte 0, ..., 255.

    The likelihood needs, for each bit position of the kept prefixes, how often the bit was seen, and the summed
    odds of the positions where it was not, in units of 2**-64.
    """
    m, edge = 1 << p, 4 * p + 4
    unseen, seen = 0, [0] * 66
    for r, n in enumerate(histogram):
        n, at = int(n), r - edge
        if not n:
            continue
        if at < 0:
            first, second = at in (-2, -8), at in (-2, -4)
            seen[0] += n * first
            seen[1] += n * second
            unseen += n * ((4 - 2 * first - second) << (62 - p))
        else:
            k, one, two = at >> 2, r & 1, r >> 1 & 1
            seen[k] += n * one
            seen[k + 1] += n * two
            seen[k + 2] += n
            unseen += n * (((7 << 61) - (one << 63) - (two << 62)) % (1 << 64) >> (k + p))
    unseen %= 1 << 64
    if not unseen:
        return 0.0 if histogram[0] else math.inf
    q = 64 - p
    seen[q - 1] += seen[q]
    used = [i for i in range(q) if seen[i]]
    if not used:
        return 0.0
    a = unseen * 2.0 * m * 2.0**-64
    counts = [float(x) for x in seen[used[0] : used[-1] + 1]]
    bound = math.fsum(c * 2.0**i for i, c in enumerate(counts, used[0]))
    x = _root(a, counts, used[0], bound, sum(counts), 0.001 * INVERSE_FISHER / math.sqrt(m))
    return 2 * m * x / (1 + BIAS / m)


def registers_histogram(registers: bytes) -> list[int]:
    return np.bincount(np.frombuffer(registers, np.uint8), minlength=256).tolist()
