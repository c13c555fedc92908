import math
import random

import numpy as np
import pytest

from mergetide.errors import IncompatibleStateError, InvalidParameterError
from mergetide.functions import hashing as H
from mergetide.functions import sizing as S
from mergetide.operators import cuckoo
from mergetide.operators.kll import Kll, capacities
from mergetide.operators.reservoir import Reservoir
from mergetide.operators.space_saving import SpaceSaving
from mergetide.operators.tdigest import TDigest, blend

SMALL = [([7], {0: 7, 0.5: 7, 1: 7}), ([0, 10], {0: 0, 0.4999999: 0, 0.5: 10, 1: 10}), ([0, 10, 20], {0.3: 0, 0.34: 10, 0.5: 10, 0.67: 20}), ([0, 10, 20, 30], {0.25: 10, 0.5: 20, 0.75: 30}), ([0, 0, 10, 10], {0.25: 0, 0.5: 10})]


@pytest.mark.parametrize("values, want", SMALL)
def test_quantile_convention(values, want):
    k, t = Kll(200), TDigest(100)
    k.add(values), t.add(values)
    for q, v in want.items():
        assert k.quantile(q) == v and t.quantile(q) == v


def one_by_one(values, k, seed):
    """Single insertions."""
    s = Kll(k, seed)
    for v in values:
        s.add([v])
    return s


def test_kll_batches_follow_the_schedule_of_single_values():
    values = [(i * 104729) % 1000003 for i in range(6000)]
    for k in (2, 5, 50):
        a, b = Kll(k, 9), Kll(k, 9)
        a.add(values)
        for i in range(0, 6000, 7):
            b.add(values[i : i + 7])
        assert a.dump() == b.dump() == one_by_one(values, k, 9).dump()


def test_kll_capacities():
    assert capacities(50, 12)[0] == 2 and capacities(50, 12)[-1] == 50 and capacities(9, 3) == (4, 6, 9)
    s = Kll(20)
    for i in range(3000):
        s.add([i])
        assert s.held <= s.budget and sum(len(x) << j for j, x in enumerate(s.levels)) == s.count == i + 1


def ranks(summary, data):
    data = np.sort(data)
    for q in np.linspace(0, 1, 21):
        v = summary.quantile(float(q))
        low, high = np.searchsorted(data, v, "left") / len(data), np.searchsorted(data, v, "right") / len(data)
        yield max(0, low - q, q - high)


def patterns(n):
    x = np.arange(n, dtype=float)
    r = np.random.default_rng(4)
    return [x, x[::-1], r.permutation(x), x % 17, x**4, np.where(x % 2, x, -x)]


@pytest.mark.parametrize("k", [50, 100, 200])
def test_kll_rank_error(k):
    bad = total = 0
    for data in patterns(4096):
        for seed in range(6):
            s = Kll(k, seed)
            s.add(data)
            bad += max(ranks(s, data)) > S.kll_rank_error(k) + 1 / 4096
            total += 1
    assert bad <= total // 20


def test_kll_merge_trees():
    data = np.random.default_rng(1).permutation(16_381).astype(float)
    for shape in ("left", "balanced"):
        shards = []
        for i, part in enumerate(np.array_split(data, 16)):
            shards.append(Kll(100, i))
            shards[-1].add(part)
        while len(shards) > 1:
            if shape == "left":
                shards[0].merge(shards.pop(1))
            else:
                for i in range(len(shards) // 2):
                    shards[i].merge(shards.pop(i + 1))
        assert shards[0].count == len(data) and sum(len(x) << i for i, x in enumerate(shards[0].levels)) == len(data)
        assert max(ranks(shards[0], data)) < S.kll_rank_error(100)


def test_kll_contract():
    s = Kll(10)
    s.add([math.nan, math.inf, 1.0, -0.0, 0.0])
    assert s.count == 3 and str(s.quantile(0)) == "-0.0" and s.quantiles([]) == [] and Kll(10).quantiles([]) == []
    assert s.quantiles([1, 0.5, 1]) == [1.0, 0.0, 1.0]
    for call in (lambda: Kll(10).quantile(0.5), lambda: s.quantile(1.1), lambda: s.quantile(math.nan), lambda: Kll(1)):
        with pytest.raises(InvalidParameterError):
            call()
    with pytest.raises(IncompatibleStateError):
        s.merge(Kll(11))
    assert Kll.load(s.dump()).dump() == s.dump()
    s.clear()
    assert s.count == 0


def test_tdigest_interpolation():
    t = TDigest(100)
    t.means, t.weights, t.total, t.low, t.high = np.array([0.0, 10.0]), np.array([4.0, 4.0]), 8.0, -2.0, 12.0
    want = {0.0: -2, 1 / 8: -2, 0.25: 0, 3 / 8: 2.5, 0.5: 5, 5 / 8: 7.5, 0.75: 10, 7 / 8: 12, 1.0: 12}
    for q, v in want.items():
        assert abs(t.quantile(q) - v) < 1e-12, q
    t.means, t.weights, t.total, t.high = np.array([0.0, 10.0, 20.0]), np.array([4.0, 1.0, 1.0]), 6.0, 20.0
    assert t.quantile(4.4 / 6) == 10 and t.quantile(5.5 / 6) == 20


@pytest.mark.parametrize("compression", [20, 100, 300])
def test_tdigest_rank_error(compression):
    for data in (np.arange(10_000.0), np.arange(10_000.0)[::-1], (np.arange(10_000) * 7919) % 10_000 * 1.0):
        t = TDigest(compression)
        t.add(data)
        assert max(ranks(t, data)) <= 0.03 and t.quantile(0) == 0 and t.quantile(1) == 9999


def test_tdigest_extremes_and_merge():
    big = 1.7976931348623157e308
    t = TDigest(20)
    t.add([big, -big] * 1000)
    got = [t.quantile(q) for q in np.linspace(0, 1, 101)]
    assert all(map(math.isfinite, got)) and got == sorted(got)
    a, b = TDigest(50), TDigest(50)
    a.add(np.append(np.linspace(0, 1, 3000), -123.5)), b.add(np.append(np.linspace(0, 1, 3000), 12345.5))
    a.merge(b)
    assert a.quantile(0) == -123.5 and a.quantile(1) == 12345.5 and a.total == 6002 and TDigest.load(a.dump()).dump() == a.dump()
    with pytest.raises(IncompatibleStateError):
        a.merge(TDigest(51))
    with pytest.raises(InvalidParameterError):
        TDigest(5)
    assert blend(-big, big, 0.5) == 0 and blend(1, 3, 0.75) == 2.5


def test_singletons_stay_exact():
    t = TDigest(100)
    data = np.random.default_rng(2).permutation(199).astype(float)
    t.add(data)
    t.compress()
    assert len(t.means) == 199 and all(t.quantile(q) == min(math.floor(q * 199), 198) for q in np.linspace(0, 1, 50))


def test_space_saving_exact_and_heavy():
    s = SpaceSaving(4)
    for x, n in (("one", 1), ("two", 2), ("three", 3), ("four", 4)):
        s.add([x] * n)
    assert s.top_k(3) == [("four", 4, 0), ("three", 3, 0), ("two", 2, 0)] and s.estimate("none") is None
    s = SpaceSaving(5)
    s.add(["apple"] * 5000 + ["banana"] * 3000 + ["carrot"] * 1000 + [f"noise{i}" for i in range(200)])
    assert {"apple", "banana"} <= {x for x, _, _ in s.top_k(5)} and s.total == 9200


def test_space_saving_intervals():
    r = random.Random(5)
    data = [r.choice([1, 1, 2, 3, *range(1000)]) for _ in range(20_000)]
    for shards in (1, 8):
        parts = [SpaceSaving(32) for _ in range(shards)]
        for i, p in enumerate(parts):
            p.add(data[i::shards])
        whole = parts[0]
        for p in parts[1:]:
            whole.merge(p)
        assert len(whole.entries) <= 32 and whole.total == len(data)
        for x, (c, e) in whole.entries.items():
            assert c - e <= data.count(x) <= c
        assert min(whole.buckets) == whole.low and SpaceSaving.load(whole.dump()).dump() == whole.dump()


def test_space_saving_merge_example():
    a, b = SpaceSaving(3), SpaceSaving(3)
    for x, n in ((0, 10), (1, 5), (2, 3)):
        a.add([x] * n)
    for x, n in ((0, 7), (3, 4), (4, 2)):
        b.add([x] * n)
    a.merge(b)
    assert sorted((c, e) for c, e in a.entries.values()) == [(7, 2), (7, 3), (17, 0)]
    with pytest.raises(IncompatibleStateError):
        a.merge(SpaceSaving(4))


def test_space_saving_newest_of_the_smallest_gives_way():
    s = SpaceSaving(3)
    s.add(["a", "b", "c", "d"])
    assert s.estimate("c") is None and s.estimate("d") == (2, 1)
    s.add(["e"])
    assert s.estimate("b") is None and s.estimate("a") == (1, 0)


def test_cuckoo_kernel_agrees_with_counts():
    for spec, n in ((cuckoo.Cuckoo(64, 6), 240), (cuckoo.Cuckoo(8, 8), 60)):
        k, counts = cuckoo.Kernel(spec), {}
        refused = 0
        for i in range(n):
            h = H.hash64(i, H.CUCKOO_ITEM_SEED)
            before = [list(x) for x in k.table], k.rng
            if k.insert(h):
                fp, a, b = spec.place(h)
                counts[fp, min(a, b)] = counts.get((fp, min(a, b)), 0) + 1
            else:
                refused += 1
                assert before == (k.table, k.rng)
        assert k.inserted == n - refused and (n == 240 or refused >= 28)
        for i in range(20_000):
            fp, a, b = spec.place(H.hash64(i, H.CUCKOO_ITEM_SEED))
            assert spec.other(spec.other(a, fp), fp) == a
            assert k.contains(H.hash64(i, H.CUCKOO_ITEM_SEED)) == ((fp, min(a, b)) in counts)
        h = H.hash64(0, H.CUCKOO_ITEM_SEED)
        assert k.delete(h) and k.inserted == n - refused - 1


def test_cuckoo_tables_are_packed_and_read_back():
    for bits in range(6, 17):
        k, other = cuckoo.Kernel(cuckoo.Cuckoo(8, bits)), cuckoo.Kernel(cuckoo.Cuckoo(8, bits))
        for i in range(24):
            k.insert(H.hash64(i, H.CUCKOO_ITEM_SEED))
        other.unpack(k.pack())
        assert other.table == k.table and other.inserted == k.inserted and len(k.pack()) == 8 * -(-4 * bits // 8)
    with pytest.raises(InvalidParameterError):
        other.unpack(b"x")


def test_cuckoo_refuses_again_without_kicks(monkeypatch):
    """A full table refuses all, and a place that was refused stays so until the table changes; results are those of trying each time."""

    class Trying(cuckoo.Kernel):
        full = False

        def insert(self, hash_):
            self.refused.clear()
            return super().insert(hash_)

    spec, calls, draw = cuckoo.Cuckoo(8, 6), [], cuckoo.Kernel._random
    hashes = [H.hash64(i % 97, H.CUCKOO_ITEM_SEED) for i in range(400)]
    for table in (hashes, [H.hash64(7, H.CUCKOO_ITEM_SEED)] * 12 + hashes):
        k, trying = cuckoo.Kernel(spec), Trying(spec)
        assert [k.insert(h) for h in table] == [trying.insert(h) for h in table] and (k.table, k.rng) == (trying.table, trying.rng)
    assert k.full
    monkeypatch.setattr(cuckoo.Kernel, "_random", lambda self: (calls.append(1), draw(self))[1])
    assert not any(k.insert(h) for h in hashes * 25) and not calls
    alone = cuckoo.Kernel(spec)
    kept = [alone.insert(hashes[0]) for _ in range(1000)]
    assert kept == [True] * 8 + [False] * 992 and len(calls) <= 1 + 2 * spec.max_kicks
    assert alone.delete(hashes[0]) and alone.insert(hashes[0]) and not alone.insert(hashes[0])


def test_cuckoo_false_positives():
    spec = cuckoo.Cuckoo.for_items(3600, 0.01)
    k = cuckoo.Kernel(spec)
    assert all(k.insert(H.hash64(i, H.CUCKOO_ITEM_SEED)) for i in range(3600)) and k.load_factor <= 0.96
    hits = sum(k.contains(H.hash64(i, H.CUCKOO_ITEM_SEED)) for i in range(1_000_000, 1_050_000))
    assert hits / 50_000 < 0.01 + 6 * math.sqrt(0.01 * 0.99 / 50_000)


def test_reservoir():
    r = Reservoir(64)
    r.extend(range(10_000))
    assert len(r.samples) == 64 and r.seen == 10_000 and len(set(r.samples)) == 64
    r = Reservoir(10)
    r.extend([1, 2, 3, 4])
    assert r.samples == [1, 2, 3, 4]
    with pytest.raises(InvalidParameterError):
        Reservoir(0)
