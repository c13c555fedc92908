import math
import zlib
from collections import Counter, defaultdict

from mergetide.llm import language_id as L

from .conftest import DATA


def slow_bits(samples, text, order=L.ORDER):
    """Code length of a text by counting every context anew."""
    lower = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in t)
    counts = defaultdict(Counter)
    joined = b"\n" * order + (b"\n" * order).join(lower(t) for t in samples) + b"\n"
    for k in range(order + 1):
        for i in range(order, len(joined)):
            counts[joined[i - k : i]][joined[i]] += 1
    total, data = 0.0, b"\n" * order + lower(text)
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            c = counts.get(data[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if data[i] in c:
                total += math.log2((n + d) / c[data[i]])
                break
            total += math.log2((n + d) / d)
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    samples = {"x": [b"The cat sat on the mat.", b"A hat! 12"], "y": ["Über die Brücke und die Mütze".encode(), b"das ist der Weg"]}
    model = L.Model(samples)
    texts = [b"The bat sat", "Brücke 7".encode(), b"z", b"\xff\xfe##", b"The cat sat on the mat." * 50]
    got = model.lengths(texts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.langs):
            assert abs(got[i, j] - slow_bits(samples[lang], t)) < 1e-3 * max(1, got[i, j])


def test_long_texts_go_piece_by_piece(monkeypatch):
    model = L.Model({"x": [b"abc abd abe"], "y": [b"xyz xyw"]})
    texts = [b"abc xyz " * 40, b"a", b"abd" * 100]
    whole = model.lengths(texts)
    monkeypatch.setattr(L, "CHUNK", 7)
    assert abs(model.lengths(texts) - whole).max() < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_odd_rows(docs, no_docs):
    rows = L.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5, 7))
    assert by[8].lang_pred in ("de", "en") and all(not r.held_out for r in rows if r.doc_id is None)
    assert L.identify(no_docs).count() == 0 and L.known_language(no_docs).count() == 0


def test_languages_of_long_texts_alone_are_learned(spark):
    """Every training text of ``fi`` is longer than what is taken of a document."""
    fi, en = "yksi kaksi kolme neljä viisi kuusi seitsemän ", "one two three four five six seven "
    rows = [(i, (fi if i % 2 else en) * (40 if i % 2 else 2), "fi" if i % 2 else "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(df, sample_docs=5, sample_bytes=400, sample_chars=100)
    assert model.langs == ["en", "fi"]
    assert model.predict([b"kuusi kaksi yksi", b"six two one"])[0] == ["fi", "en"]
    seen = []
    whole, L.Model = L.Model, lambda samples, cells: seen.append(samples)
    try:
        L.train(df, sample_docs=5, sample_bytes=400, sample_chars=100)
        L.train(df, sample_docs=3, sample_bytes=10_000, sample_chars=100)
    finally:
        L.Model = whole
    assert all(len(t.decode()) == 100 and t.decode() in fi * 40 for t in seen[0]["fi"])
    assert [len(s["fi"]) for s in seen] == [4, 3] and len(seen[0]["en"]) == 5


def test_nothing_to_learn(docs):
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_stage_keeps_columns_and_drops_the_unknown(docs):
    out = L.known_language(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert not {3, 4, 5, 7} & {r.doc_id for r in rows} and all(r.lang for r in rows)
