import re
from itertools import combinations

import numpy as np

from mergetide.llm import quality as Q
from mergetide.llm.common import stage

from .conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            hit |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_counts():
    for t in [None, "", " \n ", "a b c", "x y\nx y\n\nz\nx y", "é ü ß #*$%&|<>", " ".join("a b c d e f g h".split() * 3), " ".join(["q"] * 20), "u v w x y z 1 2 end u v w x y z 1 2", "s\x0bt\x0cu\rv"]:
        assert Q.counts(None if t is None else t.encode()) == brute(t), t


def test_rules_and_counts_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = Q.assess(docs).collect()
    assert len(rows) == len(text)
    for r in rows[:80]:
        if len(text[r.doc_id]) < 20_000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_chi_square():
    assert abs(Q.chi2_quantile(0.975, 5) - 12.8325) < 1e-3 and abs(Q.chi2_quantile(0.95, 1) - 3.8415) < 1e-3
    assert abs(Q.chi2_below(4.3515, 5) - 0.5) < 1e-4


def scatter_of(x, weight):
    mean = weight @ x / weight.sum()
    return mean, (weight[:, None] * (x - mean)).T @ (x - mean) / weight.sum()


def distances(x, centre, inverse):
    return np.maximum(np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre), 0)


def closest(d2, need):
    """Weights: 1 for the closest rows, the rest shared by rows of equal distance at the edge."""
    w, left = np.zeros(len(d2)), need
    for v in np.unique(d2):
        at = d2 == v
        w[at] = min(1, left / at.sum())
        left -= w[at].sum()
        if left <= 0:
            return w
    return w


def brute_mcd(x):
    """Centre and regularised scatter from the same starts, by sorting."""
    n, d = x.shape
    floor = np.array(list(Q.FLOORS.values()))
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    scale = np.sqrt(((q[2] - q[0]) / 1.349) ** 2 + floor**2)
    z = (x - q[1]) / scale
    length = np.sqrt((z * z).sum(axis=1, keepdims=True))
    signs, tanh = np.cov((z / np.where(length > 0, length, 1)).T, bias=True), np.cov(np.tanh(z).T, bias=True)
    spread = np.sqrt(np.maximum(np.diag(tanh), 1e-12))
    size = np.outer(scale, scale)
    fits = [(q[1], np.diag(scale**2)), (x.mean(axis=0), np.cov(x.T, bias=True)), (q[1], d * signs * size), (q[1], tanh / np.outer(spread, spread) * size)]
    need = int(np.ceil(Q.CORE * n))

    def step(fit):
        w = closest(distances(x, fit[0], np.linalg.inv(fit[1] + Q.RIDGE)), need)
        mean, cov = scatter_of(x, w)
        return mean, Q.consistency(need / n) * cov

    logdet = lambda fit: np.linalg.slogdet(fit[1] + Q.RIDGE)[1]
    fits = [step(step(f)) for f in fits]
    best = min(fits, key=logdet)
    for _ in range(Q.FIRST, Q.MOST):
        best, before = step(best), best
        if logdet(before) - logdet(best) <= Q.SETTLED:
            break
    return best


def test_estimates_against_sorting(spark):
    """Small and large groups, with ties and outliers, a constant count, and a single row."""
    rng = np.random.default_rng(1)
    groups = {"one": rng.normal(size=(1, 5)), "same": np.ones((7, 5)), "few": rng.normal(size=(9, 5))}
    for i, n in enumerate((14, 60, 900)):
        x = rng.normal(size=(n, 5)) * [1.0, 0.3, 0.8, 0.7, 0.4] + [6, 1.5, 1, 1, 0.5]
        x[: n // 6] = rng.normal(size=(n // 6, 5)) * 0.1 + [9, 3, 6, 4, 3]
        x[n // 2 :: 3] = x[n // 2]
        x[:, 3] *= i > 0
        groups[f"n{n}"] = x
    rows = spark.createDataFrame([(k, *map(float, r)) for k, x in groups.items() for r in x], ["g", *Q.DIMS])
    got = {r.g: r for r in Q.mcd(stage(rows))[0].collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        centre, scatter = brute_mcd(x) if len(x) > 1 else (x[0], np.zeros((5, 5)))
        assert np.allclose(got[k].centre, centre, atol=1e-5), k
        assert np.allclose(np.linalg.inv(np.array(got[k].inverse).reshape(5, 5)), scatter + Q.RIDGE, atol=1e-5), k


def test_smallest_determinant_of_all_subsets(spark):
    """Every subset of small groups: the starts lead to the smallest determinant in most of them (in 27 of 30 when measured), which is all that concentration steps can promise."""
    rng = np.random.default_rng(5)
    groups, least = [], []
    for g in range(6):
        x = rng.normal(size=(13, 5)) + [6, 1.5, 1, 1, 0.5]
        x[:3] += rng.normal(size=5) * 6
        groups.append(x)
        sets = [scatter_of(x, np.isin(np.arange(13), s).astype(float))[1] for s in combinations(range(13), 10)]
        least.append(min(np.linalg.slogdet(Q.consistency(10 / 13) * c + Q.RIDGE)[1] for c in sets))
    rows = spark.createDataFrame([(str(g), *map(float, r)) for g, x in enumerate(groups) for r in x], ["g", *Q.DIMS])
    got = {r.g: r.logdet for r in Q.mcd(stage(rows))[0].collect()}
    above = [got[str(g)] - v for g, v in enumerate(least)]
    assert sum(x < 1e-6 for x in above) >= 4 and min(above) > -1e-6, above


def brute_verdicts(stats):
    """(kept, d2) of rows (lang, source, vector), all estimates in memory."""
    lang, source = np.array([str(r[0]) for r in stats]), np.array([f"{r[0]}/{r[1]}" for r in stats])
    x = np.array([r[2] for r in stats])
    cut = Q.chi2_quantile(0.975, 5)

    def moments(at):
        own = x[at]
        centre, scatter = brute_mcd(own) if len(own) > 1 else (own[0], np.zeros((5, 5)))
        near = distances(own, centre, np.linalg.inv(scatter + Q.RIDGE)) <= cut
        mean, cov = scatter_of(own, near.astype(float))
        return near.sum(), mean, Q.consistency(0.975) * cov

    def mix(own, up):
        w = own[0] / (own[0] + Q.PRIOR)
        return w * own[1] + (1 - w) * up[0], w * own[2] + (1 - w) * up[1] + w * w * (1 - w) * np.outer(own[1] - up[0], own[1] - up[0])

    top, d2 = moments(np.ones(len(x), bool))[1:], np.zeros(len(x))
    languages = {k: mix(moments(lang == k), top) for k in set(lang)}
    for k in set(source):
        at = source == k
        centre, scatter = mix(moments(at), languages[lang[at][0]])
        d2[at] = distances(x[at], centre, np.linalg.inv(scatter + Q.RIDGE))
    return d2


def test_verdicts_against_brute_force(spark):
    """Every document that passes the base rules has the verdict that estimates in memory give."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stats = Q.vectors(Q.base_counts(docs)).collect()
    passing = [r for r in stats if not r.base_failed]
    want = dict(zip([r.doc_id for r in passing], brute_verdicts([(r.lang, r.source, [r[c] for c in Q.DIMS]) for r in passing]), strict=True))
    got = {r.doc_id: r for r in Q.assess(docs).collect()}
    limit = Q.chi2_quantile(1 - Q.TAIL, 5)
    for k, r in got.items():
        if k in want:
            assert abs(r.d2 - want[k]) <= 1e-3 * (1 + want[k]) and r.kept == (r.d2 <= limit), (k, r.d2, want[k])
        else:
            assert r.d2 is None and not r.kept


def test_outliers_go_from_small_and_large_sources(spark):
    """A text of symbols and doubled lines among plain ones, in a source of hundreds and in one of its own."""
    rng = np.random.default_rng(2)
    plain = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 200)))
    odd = lambda: "\n".join([f"#$%&*<>{i} |x{i} &%$#{rng.integers(0, 10**9)}" for i in range(60)] + [x for i in range(12) for x in ("same", f"y{i} z{i}")])
    rows = [(i, plain(), "en", "big") for i in range(300)] + [(1000 + i, plain(), "en", f"tiny{i}") for i in range(20)] + [(2000, odd(), "en", "big"), (2001, odd(), "en", "lone"), (2002, odd(), "xx", "lone")]
    got = {r.doc_id: r for r in Q.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    passing = [k for k in (2000, 2001, 2002) if not got[k].base_failed]
    assert passing and not any(got[k].kept for k in passing), [got[k] for k in passing]
    assert all(got[k].kept for k in got if k < 2000)


def test_odd_rows(docs, no_docs):
    rows = Q.assess(docs).collect()
    assert len(rows) == docs.count() and Q.assess(no_docs).count() == 0
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert next(r for r in rows if r.doc_id == 6).n_words == 60_000
