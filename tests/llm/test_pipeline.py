import corpus_pipeline as P
from mergetide.llm import secrets
from mergetide.llm.common import stage

from .conftest import DATA as SMALL

DATA = SMALL.replace("sf0.001", "sf0.01")  # the smallest has no secrets


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "mixing", "packing"]
    seen = [docs]
    for name, f in P.STAGES:
        seen.append(stage(f(spark, seen[-1], DATA), name))
        assert name == "packing" or seen[-1].columns == docs.columns
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen[:-1]]
    assert texts[1].keys() <= texts[0].keys() and texts[2].keys() < texts[1].keys() and texts[3].keys() == texts[2].keys()
    changed = [i for i in texts[2] if texts[2][i] != texts[3][i]]
    assert changed and all(secrets.MASK in texts[3][i] for i in changed)
    words = lambda d: sum(len((r.text or "").encode().split()) for r in d.collect())
    assert abs(words(seen[4]) / words(seen[3]) - 1) < 0.1
    packed = seen[5].groupBy().sum("size").first()[0]
    assert packed == words(seen[4])
    assert P.run(spark, DATA).count() == seen[5].count()


def test_odd_rows(spark, docs, no_docs):
    for start in (docs, no_docs):
        d = start
        for name, f in P.STAGES:
            d = stage(f(spark, d, DATA), name)
        if start is no_docs:
            assert d.count() == 0
