import math

import pytest

from mergetide.errors import InvalidParameterError
from mergetide.functions import sizing as S


def test_known_sizes():
    assert S.kll_for_error(0.01, 0.01) == 599 and S.kll_for_error(0.05, 0.10) == 90 and S.kll_for_error(0.10, 0.50) == 31
    assert S.count_min_size(0.01, 0.01) == (512, 5) and S.count_min_size(0.9, 5e-324) == (4, 745)
    assert S.count_sketch_size(0.05, 0.01) == (4096, 13)
    assert (S.cuckoo_buckets(1_000_000), S.cuckoo_bits(0.01)) == (262144, 10)
    assert [S.cuckoo_bits(x) for x in (0.9, 0.03, 0.01, 0.001, 0.00013)] == [6, 9, 10, 13, 16]
    assert abs(S.ull_error(12) - 0.012222437400144462) < 1e-16 and abs(S.ull_error(12, "mle") - 0.011888470316758097) < 1e-16
    assert abs(S.lsh_probability(0.5, 32, 4) - (1 - (1 - 0.5**4) ** 32)) < 1e-15 and abs(S.lsh_similarity(S.lsh_probability(0.3, 32, 4), 32, 4) - 0.3) < 1e-12
    assert S.hll_error(18) == 0.00203125


@pytest.mark.parametrize("p", range(5, 18))
def test_precisions_are_smallest(p):
    assert S.hll_for_error(S.hll_error(p)) == p and S.hll_for_error(S.hll_error(p) * 0.9999) == p + 1
    assert S.ull_for_error(S.ull_error(p)) == p


def test_minhash_width_is_smallest():
    for e in (0.2, 0.1, 0.031, 1.5):
        k = S.minhash_for_error(e)
        assert S.minhash_worst_error(k) <= e and (k == 1 or S.minhash_worst_error(k - 1) > e)
    with pytest.warns(DeprecationWarning):
        assert S.minhash_expected_error(4) == 0.25


@pytest.mark.parametrize(
    "call",
    [
        lambda: S.bloom_bits(0, 0.1), lambda: S.bloom_bits(5, 1.0), lambda: S.bloom_bits(5, math.nan), lambda: S.bloom_hashes(0, 5), lambda: S.cuckoo_bits(1e-9), lambda: S.cuckoo_buckets(0),
        lambda: S.hll_precision(3), lambda: S.hll_for_error(0.001), lambda: S.ull_precision(27), lambda: S.ull_for_error(math.inf), lambda: S.minhash_for_error(0), lambda: S.lsh_rows(10, 3),
        lambda: S.lsh_rows(10, 0), lambda: S.lsh_probability(1.1, 2, 2), lambda: S.count_min_size(1, 0.1), lambda: S.count_sketch_size(0.1, 0), lambda: S.kll_for_error(0), lambda: S.tdigest_for_error(1),
        lambda: S.minhash_error_at(4, -0.1), lambda: S.minhash_worst_error(0),
    ],
)
def test_invalid(call):
    with pytest.raises(InvalidParameterError, match="bad parameter"):
        call()
