"""Quality rules: base counts of each text, and robust multivariate outliers among them.

For each language and source a minimum-covariance-determinant (MCD) estimate of centre and scatter is made of
transformed counts, and documents beyond a Mahalanobis distance go.  From each of ``STARTS`` deterministic starts
concentration steps are taken: the closest share of a group's rows gives the next centre and scatter.  After ``FIRST``
steps a group goes on from the start with the smallest determinant until that determinant no longer falls.

A step needs the sums and products of exactly the closest ``CORE`` of a group's rows.  Rows are summed by group and
distance bin, which combines before the shuffle; the bin in which the share is reached is then summed again by 65,536 finer
bins, and of the last of these each row counts in part.  So a group of any size is a few hundred rows, then at most 65,536; no group is
ever gathered or sorted, and groups of all sizes are treated alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, key_of, slices, stage

WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 0.3
#: Share of a group that an estimate rests on; odds of a clean row to go; rows that the estimate of the language weighs in that of a source, and that of all in a language's.
CORE, TAIL, PRIOR = 0.75, 1e-6, 50
#: Starts, steps from each of them, most steps in all, and the fall of the logarithm of the determinant that ends them.
STARTS, FIRST, MOST, SETTLED = 4, 2, 30, 1e-4
#: Standard deviation of each transformed count that is noise: its square is added to the scatter, as a regularised determinant needs where a count hardly varies.
FLOORS = {"length": 0.5, "word": 0.1, "symbols": 0.5, "lines": 0.5, "repeats": 0.15}
DIMS = list(FLOORS)
D, PAIRS = len(DIMS), list(combinations_with_replacement(range(len(DIMS)), 2))
RIDGE = np.diag(np.square(list(FLOORS.values())))
ALL = "*"
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FD935E7A4A6D, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_START = (np.arange(256) & 0xC0 != 0x80) & ~_SPACE


def counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    chars = int(np.count_nonzero(_START[np.frombuffer(text, np.uint8)]))
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = h[:n] * _ODD[0]
    for i in range(1, WINDOW):
        w += h[i : i + n] * _ODD[i]
    order = np.argsort(w)
    same = w[order[1:]] == w[order[:-1]]
    edge = np.zeros(len(words) + 1, np.int32)
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge[:n] += again
    edge[WINDOW : WINDOW + n] -= again
    return int(np.count_nonzero(np.cumsum(edge)))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source (as keys), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = np.array([counts(t) for t in b.column("text").cast(pa.binary()).to_pylist()], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(x) for x in np.ascontiguousarray(found.T))], names=["doc_id", "lang", "source", *names])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), key_of(docs["lang"]).alias("lang"), key_of(docs["source"]).alias("source"), docs["text"].alias("text"))
    got = rows.mapInArrow(count, "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in names))
    return got.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT) * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed counts."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    return stats.withColumns({"length": F.log(n), "word": F.log(F.greatest("word_chars", F.lit(1)) / n), "symbols": F.log1p(100 * F.col("n_symbols") / n), "lines": F.log1p("n_dup_lines"), "repeats": F.sqrt(F.col("n_repeat_words") / n)})


def chi2_below(x: float, k: int) -> float:
    """Distribution function of the chi-square law with k degrees, by the series of the incomplete gamma function."""
    a, x = k / 2, x / 2
    if x > 60 + 10 * a:
        return 1.0
    term = total = 1 / a
    for i in range(1, 1000):
        term *= x / (a + i)
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a))) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, k) < p else (low, mid)
    return high


@lru_cache(4096)
def consistency(share: float) -> float:
    """What the scatter of the closest ``share`` of normal rows is multiplied by."""
    return share / chi2_below(chi2_quantile(share, D), D + 2) if share < 1 else 1.0


def _moments(columns: list[str] = DIMS) -> Column:
    """Count, sums, and products of PAIRS, as one array.  One text of SQL, as a call for each term would cost the driver more than a step does."""
    terms = ["CAST(count(1) AS DOUBLE)", *(f"sum({x})" for x in columns), *(f"sum({columns[i]} * {columns[j]})" for i, j in PAIRS)]
    return F.expr(f"array({', '.join(terms)})")


def centre_and_scatter(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From :func:`_moments`."""
    mean, second = m[1 : D + 1] / m[0], np.zeros((D, D))
    for (i, j), x in zip(PAIRS, m[D + 1 :], strict=True):
        second[i, j] = second[j, i] = x / m[0]
    return mean, second - np.outer(mean, mean)


def _fit(key: tuple, centre: np.ndarray, scatter: np.ndarray) -> dict:
    scatter = scatter + RIDGE
    return {"g": key[0], "s": int(key[1]), "centre": centre.tolist(), "inverse": np.linalg.inv(scatter).ravel().tolist(), "logdet": float(np.linalg.slogdet(scatter)[1])}


FIT = "g string, s int, centre array<double>, inverse array<double>, logdet double"


def with_distance(rows: DataFrame, fit: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, for each estimate of a row's group; ``hint``: of :func:`starts`."""
    centred = rows.join(hint(fit), "g").selectExpr("*", *(f"{x} - centre[{i}] AS _c{i}" for i, x in enumerate(DIMS)))
    d2 = " + ".join(f"{1 if i == j else 2} * _c{i} * _c{j} * inverse[{i * D + j}]" for i, j in PAIRS)
    return centred.selectExpr("*", f"greatest({d2}, 0D) AS d2").drop("centre", "inverse", *(f"_c{i}" for i in range(D)))


def starts(rows: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Four estimates for each group: medians and quartiles, mean and covariance, spatial signs, and hyperbolic tangents; and how a
    table of estimates is joined: by broadcast if there are at most ``BROADCAST_ROWS``, which is counted once as groups only get fewer."""
    quartiles = F.expr(f"array({', '.join(f'percentile_approx({x}, array(0.25, 0.5, 0.75), 1000)' for x in DIMS)})")
    scale = ", ".join(f"sqrt(pow((q[{i}][2] - q[{i}][0]) / 1.349, 2) + {FLOORS[x] ** 2!r}D)" for i, x in enumerate(DIMS))
    mid = rows.groupBy("g").agg(quartiles.alias("q"), _moments().alias("plain"))
    mid = stage(mid.selectExpr("g", "transform(q, x -> x[1]) AS mid", f"array({scale}) AS scale", "plain"), "middles")
    hint = F.broadcast if STARTS * mid.count() <= BROADCAST_ROWS else lambda x: x
    z = rows.join(hint(mid.drop("plain")), "g").selectExpr("g", *(f"({x} - mid[{i}]) / scale[{i}] AS z{i}" for i, x in enumerate(DIMS)))
    z = z.selectExpr("*", f"sqrt({' + '.join(f'z{i} * z{i}' for i in range(D))}) AS _l")
    z = z.selectExpr("g", *(f"CASE WHEN _l > 0 THEN z{i} / _l ELSE 0D END AS u{i}" for i in range(D)), *(f"tanh(z{i}) AS t{i}" for i in range(D)))
    turned = stage(z.groupBy("g").agg(*(_moments([f"{c}{i}" for i in range(D)]).alias(c) for c in "ut")), "turned")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                mid, scale = np.array(r.mid), np.array(r.scale)
                tanh = centre_and_scatter(np.array(r.t))[1]
                spread = np.sqrt(np.maximum(np.diag(tanh), 1e-12))
                out += [
                    _fit((r.g, 0), mid, np.diag(scale**2)),
                    _fit((r.g, 1), *centre_and_scatter(np.array(r.plain))),
                    _fit((r.g, 2), mid, D * centre_and_scatter(np.array(r.u))[1] * np.outer(scale, scale)),
                    _fit((r.g, 3), mid, tanh / np.outer(spread, spread) * np.outer(scale, scale)),
                ]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FIT.split(", ")])

    return stage(mid.join(hint(turned), "g").mapInPandas(solve, FIT), "starts"), hint


def _collected(near: DataFrame, bin_: str) -> DataFrame:
    """g, s, bins, m: the bins of each estimate in order, and their moments one after the other."""
    sums = near.groupBy("g", "s", bin_).agg(_moments().alias("m")).selectExpr("g", "s", f"struct({bin_} AS bin, m) AS x")
    rows = sums.groupBy("g", "s").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.selectExpr("g", "s", "transform(x, x -> x.bin) AS bins", "flatten(transform(x, x -> x.m)) AS m")


def concentrate(rows: DataFrame, fits: DataFrame, core: float, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The estimates from the closest ``core`` of the rows of each group, by each of its estimates in ``fits``; ``before``: the determinant of that."""
    near = with_distance(rows, fits.select("g", "s", "centre", "inverse"), hint)
    near = near.selectExpr("*", "16 * log2(d2 + 1e-9D) AS _t").selectExpr("*", "floor(_t) AS bin", "floor((_t - floor(_t)) * 65536) AS fine").drop("_t")

    def edge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                m = np.asarray(r.m).reshape(len(r.bins), -1)
                upto = np.cumsum(m[:, 0])
                need = math.ceil(core * upto[-1])
                at = int(np.searchsorted(upto, need))
                below = m[:at].sum(axis=0)
                out.append((r.g, r.s, r.bins[at], need - below[0], below.tolist(), need / upto[-1], r.logdet))
            yield pd.DataFrame(out, columns=["g", "s", "edge", "need", "below", "share", "before"])

    edges = _collected(near, "bin").join(hint(fits.select("g", "s", "logdet")), ["g", "s"]).mapInPandas(edge, "g string, s int, edge long, need double, below array<double>, share double, before double")
    edges = stage(edges, "edges")
    last = near.join(hint(edges.select("g", "s", "edge")), ["g", "s"]).where(F.col("bin") == F.col("edge"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                m = np.asarray(r.m).reshape(len(r.bins), -1)
                weight = np.clip((r.need - (np.cumsum(m[:, 0]) - m[:, 0])) / m[:, 0], 0, 1)
                mean, scatter = centre_and_scatter(np.asarray(r.below) + weight @ m)
                out.append(_fit((r.g, r.s), mean, consistency(r.share) * scatter) | {"before": r.before})
            yield pd.DataFrame(out)

    fine = _collected(last, "fine").join(hint(edges.select("g", "s", "need", "below", "share", "before")), ["g", "s"])
    return stage(fine.mapInPandas(solve, f"{FIT}, before double"), "fit")


def mcd(rows: DataFrame, core: float = CORE) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``rows``: g and the columns DIMS -> g, s, centre, inverse, logdet: of each group the estimate with the smallest determinant that the starts lead to; and the hint of :func:`starts`."""
    fits, hint = starts(rows)
    for _ in range(FIRST):
        fits = concentrate(rows, fits, core, hint)
    best = fits.groupBy("g").agg(F.min_by(F.struct("s", "centre", "inverse", "logdet"), F.struct("logdet", "s")).alias("x")).select("g", "x.*")
    now, done = stage(best, "best"), []
    for _ in range(FIRST, MOST):
        new = concentrate(rows, now, core, hint)
        falls = F.col("before") - F.col("logdet") > SETTLED
        done.append(new.where(~falls).drop("before"))
        now = new.where(falls).drop("before")
        if not now.limit(1).count():
            break
    return stage(reduce(DataFrame.union, [*done, now]), "estimates"), hint


def reweighted(rows: DataFrame, fit: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """g, up, n, centre, scatter: moments of the rows within the 97.5 % quantile of the estimate of their group."""
    near = with_distance(rows, fit.select("g", "centre", "inverse"), hint).where(F.col("d2") <= chi2_quantile(0.975, D))
    factor = consistency(0.975)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [centre_and_scatter(np.asarray(m)) for m in batch["m"]]
            yield batch[["g", "up"]].assign(n=[m[0] for m in batch["m"]], centre=[c.tolist() for c, _ in found], scatter=[(factor * x).ravel().tolist() for _, x in found])

    return stage(near.groupBy("g", "up").agg(_moments().alias("m")).mapInPandas(solve, "g string, up string, n double, centre array<double>, scatter array<double>"), "reweighted")


def shrunk(found: DataFrame, hint: Callable[[DataFrame], DataFrame], prior: float = PRIOR) -> DataFrame:
    """g, centre, inverse for each source: its moments mixed with ``prior`` rows of its language's, which are mixed with as many of all rows'.

    What lies between the two centres counts as scatter only as far as a group's own rows weigh (``w * w * (1 - w)``), so that a few
    odd documents don't vouch for each other, and a source of many is not judged by its language's centre.
    """
    named = lambda c: found.select(*(F.col(x).alias(f"{c}_{x}") for x in found.columns))
    top = named("a").where(F.col("a_g") == ALL)
    rows = named("s").join(hint(named("l").where(F.col("l_up") == ALL)), F.col("s_up") == F.col("l_g")).join(F.broadcast(top), F.col("l_up") == F.col("a_g"))  # top: one row

    def mix(n: float, c: list, s: list, up: tuple) -> tuple:
        c, s, w = np.array(c), np.array(s).reshape(D, D), n / (n + prior)
        apart = c - up[0]
        return w * c + (1 - w) * up[0], w * s + (1 - w) * up[1] + w * w * (1 - w) * np.outer(apart, apart)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                language = mix(r.l_n, r.l_centre, r.l_scatter, (np.array(r.a_centre), np.array(r.a_scatter).reshape(D, D)))
                fit = _fit((r.s_g, 0), *mix(r.s_n, r.s_centre, r.s_scatter, language))
                out.append((fit["g"], fit["centre"], fit["inverse"]))
            yield pd.DataFrame(out, columns=["g", "centre", "inverse"])

    return stage(rows.mapInPandas(solve, "g string, centre array<double>, inverse array<double>"), "shrunk")


def assess(docs: DataFrame, tail: float = TAIL, prior: float = PRIOR) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept: a row for each row.

    Documents that fail a base rule go and take no part in the estimates; their d2 is null.  Every other one is judged: it goes if its squared
    distance exceeds the quantile that a clean document passes with odds of ``1 - tail``.  Estimates are made by
    language and source, by language, and of all; that of a source is mixed with ``prior`` rows of its
    language's, so a source of a single document is judged by its language.  A null language or source is a value like others.  A
    null text counts as zero words and fails.  An empty table gives an empty table.
    """
    stats = vectors(base_counts(docs))
    stats = stage(stats.withColumn("g", F.concat_ws("\x1f", F.lit("source"), "lang", "source")).withColumn("lang", F.concat_ws("\x1f", F.lit("lang"), "lang")), "counts")
    levels = F.array(F.struct(F.col("g"), F.col("lang").alias("up")), F.struct(F.col("lang").alias("g"), F.lit(ALL).alias("up")), F.struct(F.lit(ALL).alias("g"), F.lit("").alias("up")))
    rows = stats.where(~F.col("base_failed")).select(F.explode(levels).alias("_g"), *DIMS).select("_g.g", "_g.up", *DIMS)
    fit, hint = mcd(rows.drop("up"))
    fit = shrunk(reweighted(rows, fit, hint), hint, prior)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = with_distance(stats.where(~F.col("base_failed")), fit, hint).select(*names, "d2", (F.col("d2") <= chi2_quantile(1 - tail, D)).alias("kept"))
    return judged.unionByName(stats.where("base_failed").select(*names, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept")))
