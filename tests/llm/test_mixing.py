import re

from mergetide.llm import mixing

from .conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, cap):
    """Targets by handing out the budget again and again."""
    target, left, open_ = {s: 0.0 for s in sizes}, float(sum(sizes.values())), set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def check(rows, table):
    sizes = {}
    for t, s in table:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s
    return {s: (taken[s], want[s]) for s in sizes}


def test_targets_and_closeness(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mix(docs).collect()
    check(rows, [(r.text, r.source) for r in docs.collect()])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_capped_sources_pass_on_their_share(spark):
    table = [("w " * n, s) for s, n in (("a", 500), ("b", 20), ("c", 10), ("d", 300), ("e", 1), ("f", 90)) for _ in range(4)]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(table)], "doc_id long, text string, source string")
    sizes = {s: sum(len(t.split()) for t, x in table if x == s) for _, s in table}
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}, 3)
    got = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want) and abs(sum(want.values()) - sum(sizes.values())) < 1e-6


def test_odd_rows(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    twice = [r for r in rows if r.doc_id == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert all(r.taken == 0 and r.size == 0 for r in rows if r.doc_id in (3, 4, 5))


def test_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_documents_as_often_as_taken(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    want = sum(r.copies for r in mixing.mix(docs).collect())
    assert out.count() == want


def test_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
