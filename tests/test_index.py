"""The full-text index: skipping by bounds against full scoring, what is read, upkeep; keyed tables that change in place."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import textindex as X
from eventloom.sources import versioned

DDL = "event_id string, workstream_id string, created_at timestamp_ntz, content string"


def records_read(spark):
    """Rows that all stages so far have read from files."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = gateway.jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


def plain(index, query, limit, workstream=None):
    inside = None if workstream is None else F.col("workstream_id") == workstream
    return [(r["event_id"], r["raw_score"]) for r in X.bm25(index, query, inside).orderBy("raw_score", "event_id").limit(limit).collect()]


def skipping(index, query, limit, workstream=None):
    return [(r["event_id"], r["raw_score"]) for r in X.top_scores(index, query, limit, workstream).collect()]


def corpus(spark, n, seed=0, words=40):
    """Words of very different frequency; many ties."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, words + 1)
    rows = [(f"e{i:06d}", f"w{i % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), " ".join(f"t{k}" for k in rng.choice(words, rng.integers(0, 30), p=share / share.sum()))) for i in range(n)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    store = X.IndexStore(spark, str(tmp_path_factory.mktemp("index")), buckets=3)
    store.add(corpus(spark, 1500))
    return store


@pytest.mark.parametrize("query", ["t0", "t0 t30 t39", "t5 t5 t0", "t38 nothing", "", "t0 t1 t2 t3 t4 t5 t6 t7 t8 t9"])
@pytest.mark.parametrize(("limit", "listed"), [(25, 2000), (3, 7), (5000, 2000)])
def test_skipping_gives_what_full_scoring_gives(kept, monkeypatch, query, limit, listed):
    monkeypatch.setattr(X, "FEW", 0)
    monkeypatch.setattr(X, "LISTED", listed)
    index = kept.index()
    for workstream in (None, "w1"):
        got, want = skipping(index, query, limit, workstream), plain(index, query, limit, workstream)
        assert [e for e, _ in got] == [e for e, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-12)


def test_a_frequent_term_is_hardly_read(spark, tmp_path, monkeypatch):
    """One term in 60,000 documents, and a rarer one: under a tenth of the postings are read, by the stages' own counts; few documents are looked up."""
    n = 60_000
    rows = spark.range(n).select(F.format_string("e%06d", "id").alias("event_id"), F.lit("w").alias("workstream_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"), F.concat(F.repeat(F.lit("often "), (F.hash("id") % 5 + 5).cast("int")), F.repeat(F.lit("filler "), (F.pmod(F.hash(F.col("id") + 1), F.lit(300))).cast("int")), F.when(F.col("id") % 20 == 0, F.lit("rarer")).otherwise(F.lit(""))).alias("content"))
    store = X.IndexStore(spark, str(tmp_path / "i"), buckets=4)
    store.add(rows)
    index = store.index()
    total = {w: index.postings.where(F.col("term") == w).count() for w in ("often", "rarer")}
    assert total == {"often": n, "rarer": n // 20}
    looked_up, documents = [], spark.createDataFrame(index.documents.where("event_id < 'e060000'").collect(), X.DOCUMENTS)
    monkeypatch.setattr(X.KeptIndex, "of_documents", lambda _, ids: (looked_up.extend(ids), documents.where(versioned.listed("event_id", sorted(ids))))[1])
    for query, most in (("often", n / 10), ("often rarer", (n + n // 20) / 10)):
        want, before = plain(index, query, 20), records_read(spark)
        got = skipping(index, query, 20)
        read = records_read(spark) - before
        cells = store.cells.read([versioned.bucket_on_driver(w, 4) for w in query.split()]).count()
        assert [e for e, _ in got] == [e for e, _ in want]
        assert read - cells < most, (query, read, cells)
    assert 0 < len(looked_up) <= 200


def test_upkeep(spark, tmp_path, monkeypatch):
    """Batches, then documents that replace older ones: as an index made at once; bounds stay above all scores."""
    monkeypatch.setattr(X, "FEW", 0)
    store = X.IndexStore(spark, str(tmp_path / "i"), buckets=5)
    a, b = corpus(spark, 300, 1), corpus(spark, 80, 2).withColumn("event_id", F.concat(F.lit("x"), "event_id"))
    new = corpus(spark, 60, 3).union(spark.createDataFrame([("e000007", "w1", dt.datetime(2024, 1, 1), None)], DDL)).where("event_id <> 'e000007' or content is null")
    store.add(a)
    old = store.index()
    store.add(b)
    store.put(new)
    whole = X.indexed(a.join(new, "event_id", "left_anti").select(a.columns).union(b).union(new))
    lazily = X.upserted(X.upserted(X.indexed(a), b), new, replaced=True)
    for query in ("t0 t1", "t3 t20 t39", "t7"):
        for workstream in (None, "w2"):
            want = plain(whole, query, 40, workstream)
            assert skipping(store.index(), query, 40, workstream) == want == skipping(lazily, query, 40, workstream)
    assert skipping(old, "t0 t1", 10) == plain(X.indexed(a), "t0 t1", 10), "a reader goes on with its version"
    sizes = [i.sizes.agg(F.sum("n"), F.sum("words")).first() for i in (store.index(), whole, lazily)]
    assert sizes[0] == sizes[1] == sizes[2]


# ---- keyed tables ----

KEYED = "k string, v int"


def values(t, **more):
    return {r["k"]: r["v"] for r in t.read(**more).collect()}


@pytest.fixture
def keyed(spark, tmp_path):
    t = versioned.Versioned(spark, str(tmp_path / "t"), KEYED, "k", 200, bloom=["k"])
    t.append(spark.createDataFrame([(f"k{i}", i) for i in range(20_000)], KEYED))
    return t


def test_upsert_touches_its_buckets(spark, keyed):
    """A change of two keys reads and writes their buckets alone: one in a hundred."""
    before, old = keyed.manifest(), records_read(spark)
    keyed.upsert(spark.createDataFrame([("k1", -1), ("new", -2)], KEYED), gone=spark.createDataFrame([("k2", 0)], KEYED))
    read = records_read(spark) - old
    changed = {b for b, p in keyed.manifest().items() if p != before.get(b)}
    assert changed == {versioned.bucket_on_driver(k, 200) for k in ("k1", "k2", "new")} and read <= 20_000 * 4 / 200
    got = values(keyed)
    assert len(got) == 20_000 and got["k1"] == -1 and got["new"] == -2 and "k2" not in got and got["k3"] == 3
    assert values(keyed, version=1)["k1"] == 1 and keyed.versions() == [1, 2]


def test_a_crash_before_publishing_changes_nothing(spark, keyed, monkeypatch):
    want = values(keyed)
    with monkeypatch.context() as m:
        m.setattr(keyed, "publish", lambda *_: (_ for _ in ()).throw(OSError("the driver died")))
        with pytest.raises(OSError):
            keyed.upsert(spark.createDataFrame([("k1", -1)], KEYED))
    assert values(keyed) == want and keyed.versions() == [1]
    keyed.upsert(spark.createDataFrame([("k1", -1)], KEYED))
    assert values(keyed) == want | {"k1": -1}
    gone = keyed.vacuum(keep=1)
    assert len(gone) == 1 and values(keyed) == want | {"k1": -1} and keyed.versions() == [2]


def test_two_writers(spark, keyed):
    after = keyed.last()
    keyed.append(spark.createDataFrame([("a", 1)], KEYED))
    with pytest.raises(versioned.Conflict):
        keyed.publish(keyed.manifest(), after)


def test_keys_open_few_row_groups(spark, keyed):
    before = records_read(spark)
    assert sorted(r["v"] for r in keyed.of_keys(["k17", "k18000", "absent"]).collect()) == [17, 18_000]
    assert records_read(spark) - before <= 3 * 20_000 / 200 * 1.5
    empty = versioned.Versioned(spark, keyed.folder + "-none", KEYED, "k")
    assert empty.read().count() == 0 and empty.of_keys(["x"]).count() == 0 and empty.vacuum() == []
    empty.upsert(spark.createDataFrame([(None, 1), ("", 2)], KEYED))
    assert sorted(r["v"] for r in empty.read().collect()) == [1, 2]
