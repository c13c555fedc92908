"""Language identification by prediction by partial matching (PPM) under frozen statistics.

For every language a context tree of order ``ORDER`` over bytes is counted on a bounded labelled sample.  A
byte seen after its context costs ``-log2(count / (total + distinct))`` bits; any other byte costs the escape
``-log2(distinct / (total + distinct))`` plus its cost in the next shorter context; a context that was never
seen is skipped free of charge; below the empty context a byte costs 8 bits.  The statistics are frozen, so
the cost of a byte depends only on it and the bytes before it, and a text's code length is an exact sum of
table entries.  The language with the shortest code wins; the score is its posterior probability under
equal priors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

ORDER = 4
#: Bounds of the training sample: documents and bytes of a language, characters taken of a document.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_CHARS = 300, 1_000_000, 20_000
#: Bound of the model: entries of the longest contexts times languages.
MAX_CELLS = 6_000_000
CHUNK = 1 << 18
UNKNOWN = "und"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_START = b"\n" * ORDER
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


class Lookup:
    """Rows by 64-bit key, probed for whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.append(keys, np.uint64(0)), values.astype(np.float32)
        self.index = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.index[at] < 0
            self.index[at[free]] = left[free]
            lost = self.index[at] != left
            left, at = left[lost], (at[lost] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if there is none."""
        at = self._slot(keys)
        got = self.index[at]
        left = np.flatnonzero((self.keys[got] != keys) & (got >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            got[left] = now = self.index[at[left]]
            left = left[(self.keys[now] != keys[left]) & (now >= 0)]
        return got


def _grams(buffer: bytes, n: int) -> np.ndarray:
    """The n bytes that end at each position from ORDER on; the oldest byte is the lowest."""
    raw = np.ndarray((len(buffer) - ORDER,), "<u8", buffer + b"\0" * 8, ORDER + 1 - n, (1,))
    return raw & _mask(n)


class Model:
    """``codes[k]``: bits of the last byte of k, after the others, for each language; ``escapes[k]``: of leaving k bytes."""

    def __init__(self, samples: dict[str, list[bytes]], max_cells: int = MAX_CELLS):
        self.langs = sorted(samples)
        self.codes, self.escapes = {}, {}
        n = len(self.langs)
        texts = [_START.join([b"", *(t.translate(_LOWER) for t in samples[x])]) + b"\n" for x in self.langs]
        self.nothing = np.full(n, 8.0, np.float32)
        for k in range(1, ORDER + 2):
            counts = [np.unique(_grams(t, k), return_counts=True) for t in texts]
            keys, inverse = np.unique(np.concatenate([x for x, _ in counts]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([c for _, c in counts]), len(keys))
            if len(keys) * n > max_cells:
                keys = np.sort(keys[np.lexsort((keys, -total))[: max_cells // n]])
                counts = [(x[m], c[m]) for x, c in counts for m in [np.isin(x, keys)]]
            contexts = np.unique(keys & _mask(k - 1))
            escape = np.zeros((len(contexts), n))
            bits = np.full((len(keys), n), np.nan)
            for i, (x, c) in enumerate(counts):
                where = np.searchsorted(contexts, x & _mask(k - 1))
                t, d = np.bincount(where, c, len(contexts)), np.bincount(where, minlength=len(contexts))
                seen = d > 0
                escape[seen, i] = np.log2((t + d)[seen] / d[seen])
                bits[np.searchsorted(keys, x), i] = np.log2((t + d)[where] / c)
            self.escapes[k - 1] = Lookup(contexts, escape)
            below = self._escape(keys, k) + self._bits(keys >> np.uint64(8), k - 1)
            self.codes[k] = Lookup(keys, np.where(np.isnan(bits), below, bits))

    def _escape(self, keys: np.ndarray, k: int) -> np.ndarray:
        table = self.escapes[k - 1]
        got = table.find(keys & _mask(k - 1))
        return np.where((got >= 0)[:, None], table.values[got], np.float32(0)) if len(table.values) else np.zeros((len(keys), len(self.langs)), np.float32)

    def _bits(self, keys: np.ndarray, k: int) -> np.ndarray:
        if not k:
            return np.broadcast_to(self.nothing, (len(keys), len(self.langs)))
        table = self.codes[k]
        got = table.find(keys)
        out = table.values[got]
        miss = np.flatnonzero(got < 0)
        if len(miss):
            out[miss] = self._escape(keys[miss], k) + self._bits(keys[miss] >> np.uint64(8), k - 1)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (not empty) in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        group, size = [], 0
        for i, t in enumerate(texts):
            for j in range(0, len(t), CHUNK):  # a long text goes piece by piece, each with the bytes before it as context
                piece = (t[j - ORDER : j] if j else _START) + t[j : j + CHUNK]
                group.append((i, piece.translate(_LOWER)))
                size += len(piece)
                if size >= CHUNK:
                    self._add(group, out)
                    group, size = [], 0
        self._add(group, out)
        return out

    def _add(self, group: list[tuple[int, bytes]], out: np.ndarray) -> None:
        if not group:
            return
        buffer = b"".join(p for _, p in group)
        bits = self._bits(_grams(buffer, ORDER + 1), ORDER + 1)
        starts = np.cumsum([0, *(len(p) for _, p in group[:-1])])
        ends = starts + [len(p) - ORDER for _, p in group]  # the first ORDER bytes of a piece are context only
        edges = np.stack([starts, ends], 1).ravel()[:-1]  # the last piece ends with the buffer
        sums = np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[::2]
        np.add.at(out, [i for i, _ in group], sums)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if not texts:
            return [], []
        bits = self.lengths(texts)
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
        return [self.langs[i] for i in best], score.tolist()


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, sample_chars: int = SAMPLE_CHARS, max_cells: int = MAX_CELLS) -> Model | None:
    """Fit on a bounded sample of the labelled documents that are not held out; None if there are none.

    Of each language the documents with the smallest hashes are taken, up to ``sample_docs`` and
    ``sample_bytes``; of a text longer than ``sample_chars`` a stretch of that length, whose place the hash
    decides.  The bounds hold before anything reaches the driver.
    """
    learn = docs.where(docs["doc_id"].isNotNull() & docs["lang"].isNotNull() & ~held_out(docs["doc_id"]) & (F.length(docs["text"]) > 0))
    learn = learn.select(docs["lang"].cast("string").alias("lang"), F.pmod(F.xxhash64(docs["doc_id"]), F.lit(1 << 30)).alias("r"), docs["text"].alias("text"))
    found = {x["lang"]: x["count"] for x in learn.groupBy("lang").count().collect()}
    if not found:
        return None
    share = lambda n: (1 << 30) if n <= 2 * sample_docs else int((1 << 30) * 1.5 * sample_docs / n)
    limits = docs.sparkSession.createDataFrame([(x, share(n)) for x, n in found.items()], "lang string, most long")
    start = F.pmod("r", F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1).cast("int") + 1
    near = learn.join(F.broadcast(limits), "lang").where("r < most").select("lang", "r", F.substring("text", start, F.lit(sample_chars)).alias("text"))
    order = Window.partitionBy("lang").orderBy("r", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = near.select("*", F.count(F.lit(1)).over(order).alias("at"), (F.sum(F.octet_length("text")).over(order) - F.octet_length("text")).alias("before"))
    samples: dict[str, list[bytes]] = {}
    for row in taken.where((F.col("at") <= sample_docs) & (F.col("before") < sample_bytes)).select("lang", "r", "text").sort("lang", "r", "text").collect():
        samples.setdefault(row["lang"], []).append(row["text"].encode())
    return Model(samples, max_cells) if samples else None


def _judge(model: Model | None, texts: pa.Array, letters: pa.Array) -> tuple[list[str], list[float]]:
    use = letters.fill_null(False).to_numpy(zero_copy_only=False)
    lang, score = [UNKNOWN] * len(use), [0.0] * len(use)
    if model and use.any():
        at = np.flatnonzero(use)
        for i, x, s in zip(at, *model.predict(texts.cast(pa.binary()).take(pa.array(at)).to_pylist()), strict=True):
            lang[i], score[i] = x, s
    return lang, score


LETTER = r"\p{L}"


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each row.

    ``und`` with score 0 if the text is null, empty or has no letter, or if nothing could be learned.  A row
    without id is never learned from and not held out.  Only the text decides; repeated rows get
    the same answer.  An empty table gives an empty table.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = _judge(fitted.value, b.column("text"), b.column("letter"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"), docs["text"].rlike(LETTER).alias("letter"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The documents with a language, with the columns of ``docs``; a missing ``lang`` is filled in.

    Those go whose prediction is ``und`` or has a score below ``least_score``.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(train(docs))
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = _judge(fitted.value, b.column("text"), b.column("_mt_letter"))
            lang = pa.array(lang, b.column("lang").type)
            columns = [pc.coalesce(b.column(c), lang) if c == "lang" else b.column(c) for c in names]
            good = pc.and_(pc.not_equal(lang, UNKNOWN), pc.greater_equal(pa.array(score, pa.float64()), least_score))
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(good)

    return docs.withColumn("_mt_letter", docs["text"].rlike(LETTER)).mapInArrow(keep, docs.schema)
