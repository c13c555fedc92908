import random

from mergetide.llm import packing

from .conftest import DATA


def slow(rows, capacity):
    bins, out = [], []
    for i, (size, s, c) in enumerate(rows):
        fits = [b for b in bins if b[0] >= size and (s is None or s not in b[1]) and (c is None or c not in b[2])]
        tight = [b for b in fits if b[0] == min(x[0] for x in fits)]
        b = min(tight, key=lambda b: b[4]) if tight else None
        if b is None:
            bins.append(b := [capacity, set(), set(), len(bins), i])
        out.append((b[3], capacity - b[0]))
        b[0] -= size
        b[4] = i  # the place in its residual's list is the time of its last change
        if s is not None:
            b[1].add(s)
        if c is not None:
            b[2].add(c)
    return out


def test_tightest_compatible_bin():
    for seed in range(30):
        r = random.Random(seed)
        rows = [(r.randint(1, 60), r.choice([None, "a", "a", "b", "c", "d", "e"]), r.choice([None, 1, 2, 3, *range(4, 40)])) for _ in range(300)]
        if seed % 2:
            rows.sort(key=lambda x: -x[0])
        assert packing.pack_rows(rows, 100) == slow(rows, 100)


def check(rows, capacity, words):
    bins, cover = {}, {}
    for r in rows:
        cover.setdefault(r.doc_id, []).append((r.start, r.size))
        if r.bin_id is None:
            assert r.size == 0
        else:
            bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in own:
            assert r.bin_offset == at
            at += r.size
        assert at <= capacity
        sources = [r.source for r in own if r.source is not None]
        assert len(sources) == len(set(sources))
    for k, n in words.items():
        at = 0
        for start, size in sorted(cover[k]):
            assert start == at
            at += size
        assert at == n


def test_documents_are_whole(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    rows = packing.pack(docs, capacity=512, group_rows=64).collect()
    check(rows, 512, words)
    assert sorted(map(str, rows)) == sorted(map(str, packing.pack(docs.repartition(5), capacity=512, group_rows=64).collect()))
    text = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for r in rows:
        if r.bin_id and r.size < 512:
            by.setdefault(r.bin_id, []).append(text[r.doc_id])
    assert all(len(x) == len(set(x)) for x in by.values())


def test_near_copies_never_share_a_bin(spark):
    """One word of the first row's text is changed, far from its ends, so that the fingerprints are within two bits."""
    words = [f"w{i % 211}" for i in range(900)]
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(300, 306)]
    rows = [(i, t, f"s{i}") for i, t in enumerate([" ".join(words), *near, "quite another text", "and one more"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    group = {r.k: r.component for r in packing.near_copies(df).collect()}
    assert len(set(group.values())) == 3 and group[1] == group[6] == 0
    got = packing.pack(df, capacity=4000, clusters=packing.near_copies(df)).collect()
    check(got, 4000, {i: len(t.split()) for i, t, _ in rows})
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(group[r.doc_id])
    assert all(len(x) == len(set(x)) for x in bins.values()) and len(bins) == 7
    assert len({r.bin_id for r in packing.pack(df, capacity=4000).collect()}) == 2


def test_query_takes_groups_of_near_copies(spark):
    from mergetide.llm import queries

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    group = {r.k: r.component for r in packing.near_copies(docs).collect()}
    got = queries.op5_best_fit_packing(spark, DATA).collect()
    check(got, packing.CAPACITY, words)
    bins = {}
    for r in got:
        if r.bin_id and r.size < packing.CAPACITY:
            bins.setdefault(r.bin_id, []).append(group[r.doc_id])
    assert all(len(x) == len(set(x)) for x in bins.values())


def test_odd_rows(docs, no_docs):
    rows = packing.pack(docs).collect()
    by_group = packing.pack(docs, clusters=packing.near_copies(docs)).collect()
    assert sorted((str(r.doc_id), r.piece, r.size) for r in by_group) == sorted((str(r.doc_id), r.piece, r.size) for r in rows)
    assert packing.pack(no_docs, clusters=packing.near_copies(no_docs)).count() == 0
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert sum(r.size for r in rows if r.doc_id == 6) == 60_000 and sum(r.doc_id == 2 for r in rows) == 2
    assert all(r.bin_id is None and r.size == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert packing.pack(no_docs).count() == 0


def test_repeated_long_rows_have_bins_of_their_own(spark):
    """Full pieces of rows that repeat a document, also under two sources or without an id, never share a bin."""
    long = " ".join(f"w{i}" for i in range(150))
    rows = [(1, long, "a"), (1, long, "a"), (1, long, "a"), (1, long, "b"), (None, long, None), (None, long, None), (2, " ".join(["x"] * 128), "a"), (2, " ".join(["x"] * 128), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, capacity=64).collect()
    check(got, 64, {})
    assert sum(r.size for r in got) == 6 * 150 + 2 * 128
    full = [r.bin_id for r in got if r.size == 64]
    assert len(full) == len(set(full)) == 16
    assert sorted(map(str, got)) == sorted(map(str, packing.pack(df.repartition(3), capacity=64).collect()))


def test_full_bins_of_a_mix(spark):
    """The mix takes documents up to three times, as the pipeline's stage before the packing does."""
    from mergetide.llm import mixing
    from mergetide.llm.common import stage

    docs = stage(mixing.mixed_documents(spark.read.parquet(f"{DATA}/documents.parquet")), "mix")
    got = packing.pack(docs, capacity=64).collect()
    check(got, 64, {})
    assert sum(r.size for r in got) == docs.select(mixing.word_count(docs["text"]).alias("n")).groupBy().sum("n").first()[0]
    by = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.bin_id:
            by.setdefault(r.bin_id, []).append(texts[r.doc_id])
    assert all(len(x) == len(set(x)) for x in by.values())
