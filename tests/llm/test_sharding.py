import pytest

from mergetide.llm import sharding
from mergetide.llm.common import new_path


def lines(df):
    return sorted(map(str, df.collect()))


def test_round_trip_and_versions(spark):
    store = sharding.ShardStore(spark, new_path(spark, "store"), target_bytes=40_000)
    parts = [spark.range(i * 1000, i * 1000 + 1000).selectExpr("id", "cast(id * 7 as string) s").coalesce(2) for i in range(6)]
    for p in parts:
        store.append(p)
    before = store.manifest()
    assert before["version"] == 6 and len(before["shards"]) == 12
    store.compact()
    after = store.manifest()
    assert after["version"] > 6 and len(after["shards"]) < 12 and not store.plan(after["shards"])
    whole = sorted(str(r) for p in parts for r in p.collect())
    assert lines(store.read()) == whole and lines(store.read(6)) == whole and store.read(2).count() == 2000
    assert store.vacuum() == []  # what is young may belong to a writer
    assert len(store.vacuum(grace=-60)) >= 12 and lines(store.read()) == whole
    store.append(parts[0])
    assert store.read().count() == 7000


def test_only_similar_runs_are_merged(spark):
    store = sharding.ShardStore(spark, new_path(spark, "store"), target_bytes=1000)
    shards = lambda *sizes: [{"name": str(i), "bytes": x} for i, x in enumerate(sizes)]
    assert store.plan(shards(10, 11, 12)) == []
    assert [[x["bytes"] for x in g] for g in store.plan(shards(10, 11, 12, 13, 300, 310, 900))] == [[10, 11, 12, 13]]
    assert [[x["bytes"] for x in g] for g in store.plan(shards(*[300] * 7))] == [[300] * 3, [300] * 3]
    assert all(sum(x["bytes"] for x in g) <= 1000 for g in store.plan(shards(*range(100, 400, 7))))


def test_one_writer_commits_a_version(spark):
    store = sharding.ShardStore(spark, new_path(spark, "store"))
    base = store.append(spark.range(3))
    store.append(spark.range(3))
    with pytest.raises(sharding.Conflict):
        store.commit(base, base["schema"], [], "late")
    assert store.read().count() == 6


def test_leftovers_are_not_read(spark):
    store = sharding.ShardStore(spark, new_path(spark, "store"))
    store.append(spark.range(3))
    spark.range(5).write.parquet(f"{store.path}/shards/a-lost")
    assert store.read().count() == 3 and store.vacuum(grace=-60) and store.read().count() == 3


def test_odd_rows(docs, no_docs):
    rows = sharding.compacted(docs, arrivals=4, target_bytes=1 << 20).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    assert sorted(r.text_bytes for r in rows) == sorted(len((r.text or "").encode()) for r in docs.collect())
    assert sharding.compacted(no_docs).count() == 0
