import numpy as np
import pytest
from pyspark.sql import functions as F

from mergetide.errors import IncompatibleStateError, InvalidParameterError
from mergetide.functions import hashing as H
from mergetide.functions import sizing
from mergetide.functions.register import register
from mergetide.operators import bloom, cuckoo, frequency, hll, kll, lsh, minhash, minmax, ranks, reservoir, space_saving, tdigest, ull
from mergetide.plans.aggregate import summarise
from mergetide.sources import states
from mergetide.sources.tables import table, table_stream, word_shingles
from mergetide.streaming import stateful, windows

from .compare import DATA


def ids(spark, a, b, name="v"):
    return spark.range(a, b).withColumnRenamed("id", name)


def test_bloom_members_and_false_positives(spark):
    spec = bloom.Bloom.for_items(4000, 0.01)
    state = spec.build(ids(spark, 0, 4000), "v")
    assert spec.probe(ids(spark, 0, 4000), "v", state).where("not maybe").count() == 0
    small = spec.probe(ids(spark, 10_000, 14_000), "v", state).where("maybe").count()
    assert small / 4000 <= 0.03
    bloom.BROADCAST_WORDS, before = 0, bloom.BROADCAST_WORDS
    try:
        assert spec.probe(ids(spark, 10_000, 14_000), "v", state).where("maybe").count() == small
    finally:
        bloom.BROADCAST_WORDS = before
    nulls = spark.createDataFrame([(None,), (1,)], "v long")
    assert sorted(map(str, (r.maybe for r in spec.probe(nulls, "v", state).collect()))) == ["None", "True"]
    assert spec.probe(nulls, "v", state.limit(0)).where("maybe").count() == 0
    with pytest.raises(InvalidParameterError):
        bloom.Bloom(0, 1)


def test_bloom_plans_hash_once(spark):
    """No filter on hashes is pushed to the scan, where all of them would be written out, and each row is hashed once."""
    spec, left, right = bloom.Bloom(9586, 7), ids(spark, 0, 100), ids(spark, 50, 60, "w")
    for df in (spec.build(right, "w"), spec.semi_join(left, "v", right, "w"), spec.anti_join(left, "v", right, "w")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "size(" not in plan and all("shiftrightunsigned" not in x for x in plan.splitlines() if "Filter" in x)
    assert sorted(r.v for r in spec.semi_join(left, "v", right, "w").collect()) == list(range(50, 60))
    odd = spark.createDataFrame([(None,), (55,), (99,)], "v long")
    assert [r.v for r in spec.semi_join(odd, "v", right, "w").collect()] == [55]
    assert sorted(str(r.v) for r in spec.anti_join(odd, "v", right, "w").collect()) == ["99", "None"]


def test_cuckoo_counts(spark):
    spec = cuckoo.Cuckoo.for_items(1000, 0.01)
    state = spec.build(ids(spark, 0, 1000), "v")
    assert spec.probe(ids(spark, 0, 1000), "v", state).where("not maybe").count() == 0
    left = spec.delete(cuckoo.Cuckoo.merge(state, state), ids(spark, 0, 1000), "v")
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, state.collect()))
    assert spec.delete(state, ids(spark, 0, 1000), "v").count() == 0
    load = spec.load(cuckoo.Cuckoo(2, 6).build(ids(spark, 0, 100), "v")).first()
    assert load.inserted == 100 and cuckoo.Cuckoo(2, 6).load(cuckoo.Cuckoo(2, 6).build(ids(spark, 0, 1000), "v")).first().overfull > 0


def test_distinct_counts(spark):
    a, b = ids(spark, 0, 10_000), ids(spark, 5000, 15_000)
    h = hll.relate(hll.registers(a, "v", 14), hll.registers(b, "v", 14), 14).first()
    assert abs(h.jaccard - 1 / 3) < 0.12 and abs(h.union - 15_000) < 600
    u = ull.relate(ull.registers(a, "v", 14), 14, ull.registers(b, "v", 12), 12).first()
    assert 0.25 <= u.jaccard < 0.42
    empty = hll.relate(hll.registers(a.limit(0), "v", 6), hll.registers(a.limit(0), "v", 6), 6).first()
    assert empty.jaccard == 1 and empty.union == 0
    assert hll.count_distinct(a, "v", 12).first()["count"] in range(9000, 11_000)
    for e in ("fgra", "mle"):
        assert ull.count_distinct(a, "v", 12, estimator=e).first()["count"] in range(9500, 10_500)
    with pytest.raises(IncompatibleStateError):
        ull.merge(ull.registers(a, "v", 8), 8, ull.registers(a, "v", 6), 6)
    with pytest.raises(InvalidParameterError):
        hll.registers(a, "v", 19)


def test_ull_golden_state(spark):
    hashes = spark.createDataFrame([(H.signed(H.splitmix64(0x0123456789ABCDEF + i)),) for i in range(20)], "h long")
    state = ull.to_state(ull.raw_registers(hashes, "h", 3), 3).first().state
    assert bytes(state).hex() == "0e08151114130e00"
    with pytest.raises(Exception, match="not an UltraLogLog state"):
        ull.from_state(spark.createDataFrame([(bytes([1] * 8),)], "state binary")).collect()
    register(spark)
    spark.createDataFrame([(bytes(state),)], "state binary").createOrReplaceTempView("states")
    row = spark.sql("select ull_estimate_fgra(state) f, ull_estimate_mle(state) m from states").first()
    assert abs(row.f - 19.76709376935443) < 1e-12 and abs(row.m - 20.790678259670717) < 1e-12


def test_minhash_and_lsh(spark):
    docs = [(1, range(0, 1000)), (2, range(0, 1100)), (3, range(0, 1200)), (4, range(5000, 6000)), (5, range(0, 1000))]
    tokens = spark.createDataFrame([(i, t) for i, r in docs for t in r], "id long, t long")
    s = minhash.signature(tokens, "t", 64, ["id"])
    c = minhash.compact(s, ["id"])
    post = lsh.postings(s, 64, 32)
    pairs = lsh.candidates(post.withColumnRenamed("id", "q"), post)
    top = lsh.top_k(pairs.where("q = 1"), c.withColumnRenamed("id", "q"), c, 2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in top] == [(5, 1.0), (1, 1.0)]
    got, members = lsh.self_join(c, 64, 32)
    assert {(r.a, r.b) for r in got.collect()} == {(1, 2), (1, 3), (2, 3)} and {r.id: r.rep for r in members.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    scores = {(r.a, r.b): r.score for r in got.collect()}
    assert abs(scores[1, 2] - 1000 / 1100) < 0.15 and lsh.remove(post, spark.createDataFrame([(4,)], "id long")).where("id = 4").count() == 0
    newer = minhash.signature(tokens.where("id = 4").withColumn("id", F.lit(1).cast("long")), "t", 64, ["id"])
    assert lsh.upsert(s, newer).where("id = 1").count() == 64
    row = spark.sql("select array(1L, 2L) a, cast(array() as array<bigint>) e").select(minhash.jaccard(F.col("e"), F.col("e")).alias("ee"), minhash.jaccard(F.col("a"), F.col("e")).alias("ae"), minhash.jaccard(F.col("a"), F.col("a")).alias("aa")).first()
    assert tuple(row) == (1.0, 0.0, 1.0)
    assert [r.shingle for r in word_shingles(spark.createDataFrame([(1, "a b\tc  d e f"), (2, "x"), (3, " "), (4, None)], "i int, t string"), "i", "t").collect()] == ["a b c d e", "b c d e f", "x"]


def test_frequencies(spark):
    ops = spark.range(20_000).select(((F.col("id") * 104729) % 128).alias("k"), (F.col("id") % 5 + 1).alias("n"))
    exact = {r.k: r.n for r in ops.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    t = frequency.CountMin(32, 5, 3)
    linear = {r.k: r.estimate for r in t.estimate(ops.select("k"), "k", t.build(ops, "k", "n")).collect()}
    for parts in (1, 4):
        got = {r.k: r.estimate for r in t.estimate(ops.select("k"), "k", t.build_conservative(ops, "k", "n", parts)).collect()}
        assert all(exact[k] <= got[k] <= linear[k] for k in exact)
    s = frequency.CountSketch(2048, 7, 3)
    noisy = ids(spark, 0, 50_000, "k").select(F.col("k").cast("string").alias("k"), F.lit(1).alias("n")).union(spark.createDataFrame([("hot-key", 5000)], "k string, n int"))
    hot = s.estimate(spark.createDataFrame([("hot-key",), ("unseen",)], "k string"), "k", s.build(noisy, "k", "n"))
    got = {r.k: r.estimate for r in hot.collect()}
    assert 4500 <= got["hot-key"] <= 5500 and abs(got["unseen"]) < 500
    cancel = spark.createDataFrame([("a", 7), ("a", -7)], "k string, n int")
    assert s.build(cancel, "k", "n").where("c <> 0").count() == 0
    with pytest.raises(Exception, match="overflow|OVERFLOW"):
        s.build(spark.createDataFrame([("a", -(1 << 63))], "k string, n long"), "k", "n").collect()
    with pytest.raises(InvalidParameterError):
        frequency.CountSketch(8, 2, 1)


def test_minmax(spark):
    ops = spark.range(20_000).select(((F.col("id") * 104729) % 128).alias("k"), ((F.col("id") * 65537) % 65536).alias("v"))
    exact = {r.k: (r.a, r.b) for r in ops.groupBy("k").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()}
    for width, depth in ((3, 4), (701, 3)):
        low, high = minmax.MinMax(width, depth, 5), minmax.MinMax(width, depth, 5, reverse=True)
        got = {r.k: r.v for r in low.estimate(ops.select("k"), "k", low.build(ops, "k", "v")).collect()}
        back = {r.k: r.v for r in high.estimate(ops.select("k"), "k", high.build(ops, "k", "v")).collect()}
        assert all(got[k] <= exact[k][0] and back[k] >= exact[k][1] for k in exact)
    one = spark.createDataFrame([(1, 7), (2, 200)], "k long, v int")
    for reverse, want in ((False, 7), (True, 200)):
        m = minmax.MinMax(1, 2, 0, reverse)
        assert {r.v for r in m.estimate(one.select("k"), "k", m.build(one, "k", "v")).collect()} == {want}
    wide = minmax.MinMax(1009, 3, 0)
    assert wide.estimate(spark.createDataFrame([(99,)], "k long"), "k", wide.build(one, "k", "v")).first().v is None


def test_two_phase_is_deterministic_with_an_order(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 3001).cast("double").alias("x"), "id")
    one = kll.build(df, "x", 20, ["g"], order=["id"])
    again = kll.build(df.repartition(7), "x", 20, ["g"], order=["id"])
    q = [0.1, 0.5, 0.9]
    assert sorted(kll.quantiles(one, q, ["g"]).collect()) == sorted(kll.quantiles(again, q, ["g"]).collect())
    counts = kll.quantiles(kll.build(df.repartition(100), "x", 200), [0.5]).first().value
    assert abs(counts - 1500) < 3000 * sizing.kll_rank_error(200)
    assert kll.build(df.limit(0), "x", 20).count() == 0
    whole = tdigest.merge(tdigest.build(df.where("g = 0"), "x", 100), tdigest.build(df.where("g > 0"), "x", 100))
    assert [r.value for r in tdigest.quantiles(whole, [0.0, 1.0]).collect()] == [0.0, 3000.0]
    register(spark)
    whole.createOrReplaceTempView("digests")
    assert abs(spark.sql("select tdigest_value(state, double(0.5)) v from digests").first().v - 1500) < 90


def test_space_saving_by_group(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("x"))
    a, b = space_saving.build(df.where("x < 3000"), "x", 20, ["g"]), space_saving.build(df.where("x >= 3000 or x = 1"), "x", 20, ["g"])
    truth = {(r.g, r.x): r["count"] * 1 for r in df.where("x < 3000").groupBy("g", "x").count().collect()}
    top = {r.g: (r.item, r["count"], r.error) for r in space_saving.top_k(a, 1, ["g"]).collect()}
    assert all(top[g][0] == 1 and top[g][1] - top[g][2] <= truth[g, 1] <= top[g][1] for g in (0, 1))
    m = space_saving.merge(a, b, ["g"])
    assert m.groupBy("g").count().where("count = 20").count() == 2
    assert space_saving.merge(a, b.limit(0), ["g"]).count() == a.count()


def test_states_describe_themselves(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    assert [(r.k, r["count"]) for r in kll.describe(kll.build(df, "x", 50, ["g"]), ["g"]).collect()] == [(50, 250)] * 2
    r = tdigest.describe(tdigest.build(df, "x", 100)).first()
    assert (r.compression, r["count"]) == (100.0, 500.0) and 0 < r.centroids <= 500
    r = space_saving.describe(space_saving.build(df, "g", 2)).first()
    assert (r.tracked, r.capacity, r.untracked) == (2, 2, 250)
    assert frequency.CountMin.total(frequency.CountMin(16, 3, 1).build(df, "g")).first().total == 500


def test_reservoir_is_uniform_and_mergeable(spark):
    df = ids(spark, 0, 2000)
    mean = np.mean([r.v for seed in range(20) for r in reservoir.sample(df, "v", 50, seed=seed).collect()])
    assert abs(mean - 1000) < 6 * 577 / np.sqrt(1000)
    halves = [reservoir.sample(df.where(w), "v", 50) for w in ("v < 700", "v >= 700")]
    assert {r.v for r in reservoir.merge(*halves, "v", 50).collect()} == {r.v for r in reservoir.sample(df, "v", 50).collect()}


def test_states_are_stored_with_their_parameters(spark, tmp_path):
    state = hll.registers(ids(spark, 0, 500), "v", 8)
    path = str(tmp_path / "s")
    states.save(state, path, "hll", p=8)
    assert sorted(states.load(spark, path, "hll", p=8).collect()) == sorted(state.collect())
    with pytest.raises(IncompatibleStateError):
        states.load(spark, path, "hll", p=9)


def run(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_streams(spark):
    events = table_stream(spark, DATA, "events")
    run(windows.windowed_registers(events, "ts", "user_id", 6, "7 days", "400 days", "1 day", ["event_type"]), "complete", "sliding")
    assert spark.table("sliding").count() > 0
    run(windows.session_registers(events, "ts", "user_id", 6, "1 hour", "1 day", ["event_type"]), "append", "sessions")
    run(stateful.fold_stream(events, "event_type", "value", lambda: kll.Kll(200), kll.Kll.load), "update", "folded")
    got = {r.event_type: kll.Kll.load(r.state).count for r in spark.table("folded").collect()}
    want = {r.event_type: r["count"] for r in table(spark, DATA, "events").where("value is not null").groupBy("event_type").count().collect()}
    assert got == want


def test_summarise_skips_nulls_and_flushes(spark, monkeypatch):
    from mergetide.plans import aggregate

    monkeypatch.setattr(aggregate, "HELD", 3)
    df = spark.range(100).select((F.col("id") % 10).alias("g"), F.when(F.col("id") % 4 != 0, F.col("id").cast("double")).alias("x"))
    got = summarise(df, ["g"], ["x"], lambda pid: kll.Kll(50), kll.Kll.load)
    assert sum(kll.Kll.load(r.state).count for r in got.collect()) == 75 and got.count() == 10


def test_kll_quantiles_takes_every_supplier(spark, tmp_path):
    """More suppliers than the sketch has room for: the ranks are those of the whole table, not of its first keys."""
    from mergetide.plans import catalogue

    n = 2000
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.col("id").cast("double").alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalogue.QUERIES["kll_quantiles"](spark, str(tmp_path)).collect()
    assert [r.q for r in got] == catalogue.QS and all(r.ok for r in got)


def test_states_of_other_parameters_do_not_merge(spark):
    df = ids(spark, 0, 100)
    b, c = bloom.Bloom(1000, 3), bloom.Bloom(4000, 7)
    pairs = [
        lambda: bloom.Bloom.merge(b.build(df, "v"), c.build(df, "v")),
        lambda: c.probe(df, "v", b.build(df, "v")),
        lambda: hll.merge(hll.registers(df, "v", 8), hll.registers(df, "v", 9)),
        lambda: hll.estimate(hll.registers(df, "v", 8), 9),
        lambda: minhash.merge(minhash.signature(df, "v", 8, []), minhash.signature(df, "v", 16, [])),
        lambda: minhash.merge(minhash.signature(df, "v", 8, []), minhash.signature(df, "v", 8, [], family=1)),
        lambda: frequency.CountMin(16, 3, 1).merge(frequency.CountMin(16, 3, 1).build(df, "v"), frequency.CountMin(16, 3, 2).build(df, "v")),
        lambda: frequency.CountSketch(16, 3, 1).merge(frequency.CountSketch(16, 3, 1).build(df, "v"), frequency.CountSketch(32, 3, 1).build(df, "v")),
        lambda: minmax.MinMax(16, 3, 1).merge(minmax.MinMax(16, 3, 1).build(df, "v", "v"), minmax.MinMax(16, 3, 1, True).build(df, "v", "v")),
        lambda: cuckoo.Cuckoo.merge(cuckoo.Cuckoo(16, 6).build(df, "v"), cuckoo.Cuckoo(16, 7).build(df, "v")),
    ]
    for call in pairs:
        with pytest.raises(IncompatibleStateError):
            call()
    assert bloom.Bloom.merge(b.build(df, "v"), b.build(df, "v").where("bit > 5"), b.build(df, "v").select("bit")).count() == b.build(df, "v").count()
    for wrong in (1.0, 1.5, 0.0):
        with pytest.raises(InvalidParameterError):
            sizing.hll_for_error(wrong)
        with pytest.raises(InvalidParameterError):
            sizing.ull_for_error(wrong)


def test_dense_states(spark):
    """One cell, the first and last cell, and none."""
    r = spark.createDataFrame([("a", 0, 3), ("a", 15, 7), ("b", 4, 200), ("c", 15, 1)], "g string, idx int, rank int")
    got = {x.g: list(x.registers) for x in hll.compact(r, 4, ["g"]).collect()}
    assert got["a"] == [3] + [0] * 14 + [7] and got["b"] == [0] * 4 + [200] + [0] * 11 and got["c"] == [0] * 15 + [1]
    assert sorted(map(tuple, hll.expand(hll.compact(r, 4, ["g"]), ["g"]).collect())) == sorted(map(tuple, r.collect()))
    assert list(hll.compact(r.limit(0).drop("g"), 4).first().registers) == [0] * 16


def test_cuckoo_insertions_in_order(spark):
    """As the kernel does them, one table for each group."""
    spec = cuckoo.Cuckoo(4, 8)
    df = spark.range(60).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = {r.v: r.accepted for r in spec.insert(df, "v", ["v"], ["g"]).collect()}
    for g in (0, 1):
        kernel = cuckoo.Kernel(spec)
        for v in range(g, 60, 2):
            assert got[v] == kernel.insert(H.hash64(v, H.CUCKOO_ITEM_SEED))
    assert len(got) == 60 and not all(got.values())


def test_space_saving_evicts_like_its_kernel(spark):
    items = [(i * 7919) % 101 if i % 3 else i % 5 for i in range(3000)]
    df = spark.createDataFrame([(x,) for x in items], "x long").coalesce(1)
    kernel = space_saving.SpaceSaving(10)
    kernel.add(items)
    got = {r.item: (r["count"], r.error) for r in space_saving.build(df, "x", 10).collect()}
    assert got == {x: tuple(e) for x, e in kernel.entries.items()} and any(e for _, e in got.values())


def test_lsh_recall_and_hot_bands(spark, monkeypatch):
    """Pairs of similarity 0.8 and more: what the bands miss is what their probability says.  Dealt bands lose nothing."""
    rng = np.random.default_rng(8)
    sets = {}
    for i in range(60):
        base = rng.choice(1 << 40, 200, replace=False)
        sets[2 * i], sets[2 * i + 1] = set(base.tolist()), set(base[: rng.integers(180, 200)].tolist())
    tokens = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, t long")
    c = minhash.signatures(tokens, "t", 32, ["id"])
    whole = {(r.a, r.b) for r in lsh.self_join(c, 32, 8)[0].collect()}
    near = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and sets[i] != sets[j]}
    same = {r.id: r.rep for r in lsh.classes(c).collect()}
    found = sum((min(same[i], same[j]), max(same[i], same[j])) in whole or same[i] == same[j] for i, j in near)
    assert found / len(near) >= 0.95, (found, len(near))
    monkeypatch.setattr(lsh, "BAND_ROWS", 1)
    assert {(r.a, r.b) for r in lsh.self_join(c, 32, 8)[0].collect()} == whole
    assert lsh.size(lsh.postings(c, 32, 8)) == len(sets)


def test_cuckoo_insertions_keep_rows_and_groups(spark):
    """Large integers beside nulls stay exact, and null and NaN are groups of their own."""
    spec, big = cuckoo.Cuckoo(2, 8), (1 << 60) + 1
    data = [(g, i, None if i % 2 else big + i) for g in (None, float("nan"), 0.5, -0.0, 0.0) for i in range(12)]
    rows = spark.createDataFrame(data, "g double, v long, x long").coalesce(1)
    got = spec.insert(rows, "v", ["v"], ["g"]).collect()
    assert sorted(str((r.g, r.v, r.x)) for r in got) == sorted(map(str, data))
    held = {}
    for r in got:
        name = "zero" if r.g == 0 else str(r.g)
        held[name] = held.get(name, 0) + r.accepted
    kernel = cuckoo.Kernel(spec)
    alone = sum(kernel.insert(H.hash64(i, H.CUCKOO_ITEM_SEED)) for i in range(12))
    assert alone <= 8 and held == {"None": alone, "nan": alone, "0.5": alone, "zero": held["zero"]} and held["zero"] <= 8


def more_suppliers(spark, path):
    """More suppliers of a nation than a summary has room for: even, of two values, of odd doubles, and without a nation."""
    odd = [float("nan"), float("inf"), -float("inf"), 0.0, None]
    data = [(0, float(i * 7919 % 3001)) for i in range(3001)] + [(1, float(i % 2)) for i in range(2400)] + [(2, odd[i % 5] if i % 2 else i / 7) for i in range(2500)] + [(None, i * 0.25 - 9) for i in range(1500)]
    data += [(3, -0.0)] * 9 + [(4, None), (5, float("nan")), (6, 1e300)]
    rows = spark.createDataFrame(data, "s_nationkey int, s_acctbal double").withColumn("s_suppkey", F.monotonically_increasing_id())
    rows.repartition(3).write.parquet(f"{path}/supplier.parquet")


def same_as_sql(spark, path, name):
    import duckdb

    from mergetide.plans import catalogue

    c = duckdb.connect()
    c.sql(f"CREATE VIEW supplier AS SELECT * FROM '{path}/supplier.parquet/*.parquet'")
    want = sorted(map(str, c.sql(f"SELECT s_nationkey, q, value FROM ({catalogue.SQL[name]})").fetchall()))
    got = catalogue.QUERIES[name](spark, str(path)).select("s_nationkey", "q", "value").collect()
    assert sorted(str(tuple(r)) for r in got) == want and len(want) == 7 * len(catalogue.QS)


def test_kll_quantile_is_exact_beyond_the_sketch(spark, tmp_path):
    more_suppliers(spark, tmp_path)
    same_as_sql(spark, tmp_path, "kll_quantile")


def test_exact_ranks_whatever_the_cuts(spark):
    """Without groups, with repeated queries, and with cuts that are far off or missing."""
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("v"))
    for cuts in ([], [5.0], [-1.0, 2e9], [499.0, 500.0]):
        near = spark.createDataFrame([(c,) for c in cuts], "value double")
        got = sorted((r.q, r.value) for r in ranks.exact(rows, "v", near, [0.5, 0, 1, 0.5, 0.999]).collect())
        assert got == [(0.0, 0.0), (0.5, 500.0), (0.5, 500.0), (0.999, 999.0), (1.0, 999.0)]
    assert ranks.exact(rows.limit(0), "v", near, [0.5]).count() == 0 and ranks.around([0, 0.5, 1], 0.25) == [0.0, 0.25, 0.75, 1.0]


def test_tdigest_quantile_is_exact_beyond_the_buffer(spark, tmp_path):
    more_suppliers(spark, tmp_path)
    same_as_sql(spark, tmp_path, "tdigest_quantile")
