"""Near-duplicate vectors by tiles in principal-component order.

Equal vectors of a label are one class.  Class vectors are turned into the basis of principal components, so
that leading dimensions hold most of the products, sorted by the first component, and packed into tiles.
Two tiles are compared unless their ranges of the first component are too far apart for the threshold.
Within a pair of tiles, products are accumulated a few dimensions at a time; the rest of each product is
bounded by the product of the suffix norms, rows and columns without a pair that can still reach the
threshold are dropped, and the comparison ends when none is left.  A tile pair returns, for each
vector with links, their number and one edge to its component within the pair, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stage

THRESHOLD = 0.93
#: Vectors and bytes of a tile; dimensions taken at a time; principal components that are computed.
TILE_ROWS, TILE_BYTES, STEP, COMPONENTS = 2048, 4 << 20, 16, 64
#: Computed cosines this close to the threshold are computed again from the vectors as given.
MARGIN = 1e-9


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(e):
    """Whether a vector can link: not null, not zero, all components there and finite."""
    return e.isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))


def _image(known: dict[int, np.ndarray]):
    """Of each dimension the cells of the second moments times a matrix: that in ``known``, or else the first of a random one."""

    def image(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, (_, v) in _by_dim(b, 0).items():
                u = _unit(v)
                sums[d] = sums.get(d, 0) + u.T @ (u @ known.get(d, probe(d)))
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, d)), pa.array(np.arange(s.size)), pa.array(s.ravel())], names=["dim", "cell", "v"])

    return image


def probe(d: int) -> np.ndarray:
    """The start of the search for components: as many directions as are wanted, all if the dimension has no more."""
    return np.eye(d) if d <= COMPONENTS else np.linalg.qr(np.random.default_rng(d).normal(size=(d, COMPONENTS)))[0]


def turn(u: np.ndarray, components: np.ndarray) -> np.ndarray:
    """Coordinates whose products are those of ``u``: along the components first, then what is left of each vector."""
    along = u @ components
    return along if components.shape[0] == components.shape[1] else np.hstack([along, u - along @ components.T])


def _by_dim(b: pa.RecordBatch, column: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch, by dimension."""
    lists = b.column(column)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    return {int(d): (rows := np.flatnonzero(sizes == d), flat[offsets[rows][:, None] + np.arange(d)]) for d in np.unique(sizes)}


def bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension its leading principal components, as columns, the largest first, by randomised subspace iteration.

    The driver holds at most ``COMPONENTS`` numbers for each dimension of a vector.
    """

    def images(known: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        cells: dict[int, dict[int, float]] = {}
        for r in classes.select("e").mapInArrow(_image(known), "dim long, cell long, v double").groupBy("dim", "cell").agg(F.sum("v").alias("v")).collect():
            cells.setdefault(r["dim"], {})[r["cell"]] = r["v"]
        return {d: np.array([c[i] for i in range(len(c))]).reshape(d, -1) for d, c in cells.items()}

    first = images({})
    known = {d: np.linalg.qr(y)[0] if y.shape[0] > y.shape[1] else np.eye(d) for d, y in first.items()}
    second = images(known) if any(d > COMPONENTS for d in first) else first
    out = {}
    for d, q in known.items():
        small = q.T @ (second[d] if q.shape[1] < d else first[d])
        out[d] = q @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
    return out


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j; ``label`` leads each element to the smallest of its component."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def compare(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of ``a`` and ``b`` whose cosine reaches the threshold, block by block; ``same``: only i < j."""
    if not same:
        u, w = turn(_unit(a), basis), turn(_unit(b), basis)
    else:
        u = w = turn(_unit(a), basis)
    d = u.shape[1]
    steps = list(range(0, d, STEP)) + [d]
    norms = lambda x: {k: np.sqrt(np.maximum((x[:, k:] ** 2).sum(axis=1), 0)) for k in steps[1:]}
    nu, nw = norms(u), norms(w)
    for at in range(0, len(u), 512):
        rows, cols = np.arange(at, min(at + 512, len(u))), np.arange(at if same else 0, len(w))
        p = np.zeros((len(rows), len(cols)))
        for k, to in zip(steps, steps[1:]):
            p += u[rows, k:to] @ w[cols, k:to].T
            alive = p + np.outer(nu[to][rows], nw[to][cols]) >= threshold - MARGIN
            r, c = alive.any(axis=1), alive.any(axis=0)
            if not r.any():
                break
            if r.sum() * c.sum() < 0.7 * p.size:
                rows, cols, p = rows[r], cols[c], p[np.ix_(r, c)]
        else:
            i, j = np.nonzero(p >= threshold - MARGIN)
            cosine, i, j = p[i, j], rows[i], cols[j]
            good = cosine >= threshold
            for x in np.flatnonzero(np.abs(cosine - threshold) <= MARGIN):
                v, z = a[i[x]].astype(float), b[j[x]].astype(float)
                v, z = v / np.abs(v).max(), z / np.abs(z).max()
                good[x] = math.fsum(v * z) / math.sqrt(math.fsum(v * v) * math.fsum(z * z)) >= threshold
            if same:
                good &= i < j
            yield i[good], j[good]


def _tiles(basis):
    """Sorted rows (label, dim, first, id, n, e) -> tiles of consecutive rows of one label and dimension."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def tile() -> pa.RecordBatch:
            first = [r[2] for r in rows]
            vectors = np.array([r[5] for r in rows])
            short = vectors.astype(np.float32)
            vectors = short if np.array_equal(short, vectors) else vectors
            blob = [np.array([r[3] for r in rows], np.int64).tobytes(), np.array([r[4] for r in rows], np.int64).tobytes(), vectors.tobytes()]
            name = xxhash.xxh64_intdigest(b"".join(blob)) - (1 << 63)
            return pa.RecordBatch.from_arrays([*(pa.array([x]) for x in (rows[0][0], rows[0][1], name, min(first), max(first)))] + [pa.array([x], pa.binary()) for x in blob], names=["label", "dim", "tile", "low", "high", "ids", "ns", "vectors"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5).to_numpy(zero_copy_only=False), strict=True):
                if rows and (row[:2] != rows[0][:2] or len(rows) >= max(1, min(TILE_ROWS, TILE_BYTES // (8 * row[1])))):
                    yield tile()
                    rows = []
                rows.append(row)
        if rows:
            yield tile()

    return cut


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``classes`` (staged): label, e, id, n -> id, links, hub: for each tile pair, its vectors with links, how many, and an edge."""
    spark = classes.sparkSession
    basis = spark.sparkContext.broadcast(bases(classes))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, first = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for d, (rows, v) in _by_dim(b, 1).items():
                dim[rows], first[rows] = d, _unit(v) @ basis.value[d][:, 0]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(dim), pa.array(first), b.column("id"), b.column("n"), b.column("e")], names=["label", "dim", "first", "id", "n", "e"])

    order = ["label", "dim", "first", "id"]
    rows = stage(classes.select("label", "e", "id", "n").mapInArrow(project, "label string, dim long, first double, id long, n long, e array<double>"), "projected")
    parts = max(1, rows.count() // (4 * TILE_ROWS))
    tiles = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tiles = stage(tiles.mapInArrow(_tiles(basis), "label string, dim long, tile long, low double, high double, ids binary, ns binary, vectors binary"), "tiles")
    gap = math.sqrt(2 - 2 * threshold) + 1e-6
    head = ["label", "dim", "tile", "low", "high"]
    a, b = tiles.select(*head).alias("a"), tiles.select(*head).alias("b")
    near = (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.struct("a.low", "a.tile") <= F.struct("b.low", "b.tile")) & (F.col("b.low") - F.col("a.high") <= gap)
    # one label may have many tiles: its pairs are dealt over more tasks the more there are
    salts = max(1, tiles.count() // 256)
    a = a.withColumn("salt", F.pmod(F.xxhash64("tile"), F.lit(salts)))
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    a, b, near = a.alias("a"), b.alias("b"), near & (F.col("a.salt") == F.col("b.salt"))
    pairs = stage(a.join(b, near).select(F.col("a.dim").alias("dim"), F.col("a.tile").alias("a"), F.col("b.tile").alias("b")), "tile-pairs")
    blob = lambda x: tiles.select(F.col("tile").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("ids", "ns", "vectors")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                one = {c: batch.column(c)[x].as_py() for c in batch.schema.names}
                d, same = one["dim"], one["a"] == one["b"]
                side = {}
                for s in "ab":
                    ids, ns = np.frombuffer(one[f"{s}_ids"], np.int64), np.frombuffer(one[f"{s}_ns"], np.int64)
                    raw = one[f"{s}_vectors"]
                    side[s] = ids, ns, np.frombuffer(raw, np.float32 if len(raw) == 4 * d * len(ids) else np.float64).reshape(-1, d).astype(np.float64)
                (ia, na, va), (ib, nb, vb) = side["a"], side["b"]
                shift = 0 if same else len(ia)
                ids, count = (ia, np.zeros(len(ia), np.int64)) if same else (np.concatenate([ia, ib]), np.zeros(len(ia) + len(ib), np.int64))
                label = np.arange(len(ids))
                for i, j in compare(va, vb, basis.value[d], threshold, same):
                    np.add.at(count, i, nb[j])
                    np.add.at(count, j + shift, na[i])
                    _unite(label, i, j + shift)
                hit = np.flatnonzero(count)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(count[hit]), pa.array(ids[label[hit]])], names=["id", "links", "hub"])

    met = pairs.join(blob("a"), "a").join(blob("b"), "b").select("dim", "a", "b", *(f"{s}_{c}" for s in "ab" for c in ("ids", "ns", "vectors")))
    return stage(met.mapInArrow(meet, "id long, links long, hub long"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors`` (vec_id, embedding, label).

    Only vectors of one label (not null) and one dimension are compared.  Vectors that are null, empty, zero, or hold a
    null or non-finite component link with nothing, and so do rows without vec_id, whose component is null.
    Equal vectors link with each other.  Rows that repeat a vec_id with the same vector count as vectors each;
    with different vectors they are one vertex of the graph.  An empty table gives an empty table.
    """
    e = F.col("e")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("string").alias("label"), F.transform(vectors["embedding"].cast("array<double>"), lambda x: x + F.lit(0.0)).alias("e"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(e)
    keys = [F.when(good, F.xxhash64(*x)).alias(f"k{i}") for i, x in enumerate((("label", "e"), (F.lit(7), "e", "label")))]
    keyed = rows.select("vec_id", "label", "e", *keys)
    classes = stage(keyed.where("k0 is not null").groupBy("k0", "k1").agg(F.any_value("label").alias("label"), F.any_value("e").alias("e"), F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    found = links(classes, threshold)
    number = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = stage(connected_components(found.select(F.col("id").alias("a"), F.col("hub").alias("b"))), "components")
    named = classes.select("k0", "k1", "id", "n").join(number, "id", "left").join(comps, F.col("id") == F.col("node"), "left")
    named = stage(named.select("k0", "k1", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("comp", "id").alias("component_id")), "named")
    out = stage(keyed.select("vec_id", "k0", "k1"), "rows").join(named, ["k0", "k1"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
