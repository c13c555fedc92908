import re

import numpy as np
import xxhash

from mergetide.llm import simhash

from .conftest import DATA


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fps):
    """Smallest reachable position, for fingerprints in order."""
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    links = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    while True:
        new = np.array([label[row].min() for row in links])
        if (new == label).all():
            return label
        label = new


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [brute_fingerprint(r.text) for r in rows]
    label = components(fps)
    want = [(r.doc_id, f"{f:016x}", rows[x].doc_id) for r, f, x in zip(rows, fps, label, strict=True)]
    assert sorted(map(tuple, simhash.near_duplicates(docs).drop("kept").collect())) == want


def test_long_lists_lose_no_link(spark):
    """Families of close fingerprints, far above LONG_LIST, in chains of one and two bits."""
    rng = np.random.default_rng(3)
    fps = set()
    for base in rng.integers(0, 1 << 63, 3):
        x = int(base)
        for _ in range(150):
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            fps.add(x)
        fps |= {int(base) ^ (1 << int(b)) for b in range(0, 64)} | {int(base) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from mergetide.llm.common import connected_components, stage

    comp = {r.node: r.comp for r in connected_components(simhash.fingerprint_links(stage(df))).collect()}
    label = components(fps)
    groups = {}
    for x, l in zip(signed, label, strict=True):
        groups.setdefault(int(l), set()).add(comp.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({*map(frozenset, groups.values())}) == len(groups)


def test_blocks_tally_shared_bytes():
    """Of six or more shared positions the blocks within them cover all; of fewer they never reach six."""
    from itertools import combinations

    assert len(simhash.BLOCKS) == 14
    for n in range(8):
        for same in combinations(range(8), n):
            tally = len(set().union(*(b for b in simhash.BLOCKS if set(b) <= set(same))))
            assert tally == n if n >= simhash.MIN_BYTES else tally < simhash.MIN_BYTES


def test_links_of_short_lists_are_all_pairs_within_two_bits(spark):
    from mergetide.llm.common import stage

    rng = np.random.default_rng(7)
    fps = {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 300)}
    for x in list(fps):
        for bits in (1, 2, 3, 4):
            fps.add(int(np.int64(x) ^ np.bitwise_or.reduce(np.int64(1) << rng.choice(64, bits, replace=False).astype(np.int64))))
    fps = sorted(fps)
    u = np.array(fps, np.int64).view(np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2, 1))
    got = simhash.fingerprint_links(stage(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()
    assert {(r.a, r.b) for r in got} == {(fps[i], fps[j]) for i, j in near}


def test_odd_rows(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == 1
    assert {by[i].fingerprint for i in (3, 4, 5)} == {"0" * 16} and {by[i].component_id for i in (3, 4, 5)} == {3}
    assert sorted(r.component_id is None for r in rows if r.doc_id is None) == [False, True]


def test_one_of_each_group_stays(docs, no_docs):
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i) == [1, 3, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert simhash.deduplicated(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0
