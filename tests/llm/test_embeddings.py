import numpy as np
import pytest

from mergetide.llm import embeddings as E

from .conftest import DATA


def brute(rows, threshold=E.THRESHOLD):
    """vec_id -> (links, component) for rows (vec_id, vector, label) with distinct ids."""
    ok = lambda v, label: label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [(i, np.array(v, float), x) for i, v, x in rows if ok(v, x)]
    links = {i: set() for i, _, _ in rows}
    for a, (i, u, x) in enumerate(good):
        for j, w, y in good[:a]:
            if x == y and len(u) == len(w) and u @ w / np.sqrt((u @ u) * (w @ w)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                if (x := todo.pop()) not in comp:
                    comp[x] = i
                    todo += links[x]
    return {i: (len(links[i]), comp[i]) for i in links}


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_documents_of_the_tables(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check(spark, rows)


def test_tiles_and_families(spark, monkeypatch):
    """Many small tiles; families of copies and near copies that span them, and vectors close to the threshold."""
    monkeypatch.setattr(E, "TILE_ROWS", 40)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 24))
    vectors = [base[i % 12] + rng.normal(size=24) * rng.choice([0, 0.05, 0.25, 0.35]) for i in range(500)]
    check(spark, [(int(i), [float(x) for x in v], int(i) % 3) for i, v in zip(rng.permutation(5000)[:500], vectors, strict=True)])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [1.0, nan], 1), (9, [1.0, None], 1), (10, [inf, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [1e-30, 0.0], 1), (14, [3e38, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    assert got == {i: (3, 1, i == 1) if i in (1, 2, 13, 14) else (0, i, True) for i in range(1, 15)}
    twice = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 2 + [(None, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in E.near_duplicates(twice).collect()) == [("1", 1, "1"), ("1", 1, "1"), ("None", 0, "None")]
    assert E.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_bounds_lose_nothing(same):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(700, 40)) * np.linspace(3, 0.1, 40)
    a[100:300] = a[:200] + rng.normal(size=(200, 40)) * 0.2
    b = a if same else a[::-1] + rng.normal(size=a.shape) * 0.1
    basis = np.linalg.eigh(a.T @ a)[1][:, ::-1]
    got = {(int(i), int(j)) for x, y in E.compare(a, b, basis, 0.93, same) for i, j in zip(x, y, strict=True)}
    cosine = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(cosine >= 0.93), strict=True) if not same or i < j}


def test_long_vectors(spark):
    """1024 dimensions, more than there are components: the links of all pairs."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 1024)) * np.linspace(3, 0.1, 1024)
    x = np.vstack([base, base + rng.normal(size=base.shape) * 0.3, base[:5] * 2, rng.normal(size=(20, 1024))])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2)
    np.fill_diagonal(linked, False)
    assert linked.sum() > 20 and all(got[i].n_links == linked[i].sum() for i in range(len(x)))
    v = E.probe(1024)
    assert np.allclose(E.turn(u, v) @ E.turn(u, v).T, u @ u.T)
