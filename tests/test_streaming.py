"""Micro-batches in any order, with failures between, against a rebuild; sessions sent again and restarted; feedback against the plain fold."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from eventloom import schema as S
from eventloom.functions import payloads as P
from eventloom.operators import ingest, projections as J, textindex as X
from eventloom.streaming import observers as O
from eventloom.streaming.ingest import Store, append_batch, known_events, new_entries

COLUMNS = "event_id string, workstream_id string, channel int, category int, principal_id string, payload string"


def captures(spark, events):
    rows = spark.createDataFrame([(i, w, 0, c, "u", json.dumps(p)) for i, w, c, p in events], COLUMNS)
    return rows.withColumn("valid_at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("recorded_at", F.col("valid_at")).withColumn("source", F.lit("t")).withColumn("schema_version", F.lit(1))


def some_events(seed):
    """Facts that repeat and contradict each other, decisions with actions and outcomes, a skill, a goal."""
    rng, out = random.Random(seed), []
    for i in range(24):
        triples = [{"subject": f"S{rng.randrange(3)}'s team", "predicate": rng.choice("pq"), "object": rng.choice(["a", "A ", "b"])} for _ in range(rng.randrange(3))]
        out.append((f"f{i}", f"w{rng.randrange(2)}", S.FACT, {"$type": "fact", "statement": rng.choice(["One thing", " one thing", "another", f"own {i}"]), "supportingEvents": ["f0"], "triples": triples}))
    for i in range(6):
        out.append((f"d{i}", "w0", S.DECISION, {"$type": "decision", "statement": f"decide {i}", "rationale": "since", "supportingEvents": ["f1", "f2", "f1"]}))
        for k in range(rng.randrange(3)):
            out.append((f"a{i}{k}", "w0", S.ACTION, {"$type": "action", "statement": "act", "decisionEvent": f"d{i}"}))
            out += [(f"o{i}{k}{j}", "w0", S.OUTCOME, {"$type": "outcome", "statement": "came out", "actionEvent": f"a{i}{k}", "polarity": rng.randrange(-1, 2)}) for j in range(rng.randrange(3))]
    out.append(("a9", "w0", S.ACTION, {"$type": "action", "statement": "of an unknown decision", "decisionEvent": "dx"}))
    out.append(("s", "w0", S.EVIDENCE, {"$type": "skill", "name": "pull", "procedure": "gently"}))
    return [*out, ("g", "w1", S.GOAL, {"$type": "goal", "statement": "arrive"})]


def clock():
    at = [dt.datetime(2024, 2, 1)]

    def now():
        at[0] += dt.timedelta(seconds=1)
        return at[0].strftime("%Y-%m-%d %H:%M:%S")

    return now


def rows(df, *columns):
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))


def test_batches_in_any_order_equal_the_rebuild(spark, tmp_path):
    """A projector that dies half-way is logged, the batch is run again, and everything is there once."""
    events = some_events(5)
    random.Random(1).shuffle(events)
    store, derived = Store(spark, str(tmp_path / "store")), O.Derived(spark, str(tmp_path / "derived"), 4)
    watch = derived.observers(store)
    broken = O.pipeline(store, [O.Projector(p.name, p.categories, (lambda *_: 1 / 0) if p.name == "duplicates" else p.apply) for p in derived.projectors()])
    now, parts = clock(), [events[k::3] for k in range(3)]
    for k, part in enumerate(parts):
        batch = captures(spark, part + parts[0][:4] + [("bad", "w0", S.FACT, {"$type": "odd"})])
        if k == 1:
            with pytest.raises(O.Failed, match="duplicates"):
                append_batch(store, now, ["w1"], [broken])(batch, k)
            got = O.processing(store).where("projection in ('triples', 'duplicates', 'decision_chains') and status = 'Failed'").collect()
            assert got and {r["projection"] for r in got} == {"duplicates"} and all("ZeroDivisionError" in r["error"] for r in got)
        append_batch(store, now, ["w1"], watch)(batch, k)
    append_batch(store, now, ["w1"], watch)(batch, 2)  # all is done: nothing changes
    assert O.processing(store).where("status = 'Failed'").count() == 0
    assert store.log().count() == len(events) and store.read("rejects", "event_id string").count() == 3
    for name in ("visibility", "outbox"):
        assert store.read(name, "event_id string").distinct().count() == store.read(name, "event_id string").count() == len(events)

    wide = O.widened(store.log()).cache()
    triples = J.triples_of(wide.where("category = 1"))
    for kept, built in ((derived.triples, triples), (derived.contradictions, J.contradictions(triples)), (derived.duplicates, J.duplicates(wide)), (derived.chains, J.decision_chains(wide))):
        columns = kept.read().columns
        assert rows(kept.read(), *columns) == rows(built, *columns) and kept.read().count() > 0
    assert derived.statements[S.FACT].read().count() == 24 and rows(derived.skills.read(), "name", "procedure") == ["('pull', 'gently')"]
    assert derived.chains.read().where("decision_id = 'dx'").first()["closed"] is False
    text = wide.select("event_id", "workstream_id", "created_at", "content")
    for query in ("one thing", "decide since", "gently"):
        assert [r["event_id"] for r in X.top_scores(derived.index.index(), query, 9).collect()] == [r["event_id"] for r in X.bm25(X.indexed(text), query).orderBy("raw_score", "event_id").limit(9).collect()]


def test_weights_batch_by_batch_equal_the_fold(spark, tmp_path):
    """Decisions and actions first, then outcomes in several batches, one of them run twice."""
    events = some_events(8)
    early, late = [e for e in events if e[2] != S.OUTCOME], [e for e in events if e[2] == S.OUTCOME]
    store, derived, now = Store(spark, str(tmp_path / "store")), O.Derived(spark, str(tmp_path / "derived"), 3), clock()
    for k, part in enumerate([early, late[::2], late[1::2]]):
        observers = [O.pipeline(store, derived.projectors()[-1:]), derived.learned]
        for _ in range(2 if k == 1 else 1):
            append_batch(store, now, [], observers)(captures(spark, part), k)
    want = {r["event_id"]: (r["weight"], r["updates"]) for r in J.feedback_weights(O.widened(store.log())).collect()}
    assert {r["event_id"]: (round(r["weight"], 6), r["updates"]) for r in derived.weights.read().collect()} == want and len(want) > 3


def test_feedback_of_a_hot_target(spark, monkeypatch):
    """One target with 30,000 clamped steps, folded in runs of 16: as step by step."""
    monkeypatch.setattr(J, "FOLD_BITS", 4)
    rng = random.Random(2)
    plain = [(rng.choice([0.05, 0.05, -0.05, 0.0]) if k % 9000 < 4000 else rng.choice([0.05, -0.05, -0.05])) for k in range(30_000)]
    steps = [("hot", k, f"o{k:06d}", d) for k, d in enumerate(plain)] + [("cold", 1, "o", -0.05)]
    rng.shuffle(steps)
    got = {r["event_id"]: r for r in J.feedback_maps(spark.createDataFrame(steps, "event_id string, at long, outcome_id string, delta double")).withColumn("w", J.moved(F.lit(J.WEIGHT_START))).collect()}
    w = J.WEIGHT_START
    for d in plain:
        w = min(5.0, max(0.1, w + d))
    assert abs(got["hot"]["w"] - w) < 1e-6 and got["hot"]["updates"] == 30_000 and abs(got["cold"]["w"] - 0.95) < 1e-9


def test_seams(spark):
    """A host's redactor, classifier and shape selector take the place of the built-in ones."""
    seams = ingest.Seams(redact=lambda p: F.struct(p.withField("statement", F.upper(p["statement"])).alias("payload"), F.lit(0).alias("hits")), classify=lambda text, hit, category: F.when(text.contains("SECRET"), 3).otherwise(1), shape=lambda text, category: F.length(text) % 2)
    got = ingest.prepared(captures(spark, [("e", "w", S.FACT, {"$type": "fact", "statement": "a secret"})]), "2024-02-01 00:00:00", seams).select(P.parsed(F.col("payload"))["statement"].alias("s"), "classification", "content_shape").first()
    assert tuple(got) == ("A SECRET", 3, 0)


def test_known_ids(spark, tmp_path, monkeypatch):
    from eventloom.streaming import ingest as I

    store = Store(spark, str(tmp_path))
    append_batch(store, clock())(captures(spark, [(f"e{i:03d}", "w", S.FACT, {"$type": "fact", "statement": "x"}) for i in range(50)]), 0)
    ask = spark.createDataFrame([("e007",), ("e049",), ("e050",), ("a",)], "event_id string")
    for listed, most in ((2000, 9), (1, 9), (1, 0)):
        monkeypatch.setattr(I, "LISTED", listed)
        monkeypatch.setattr(I, "MOST_IDS", most)
        got = {r[0] for r in known_events(store, ask).collect()}
        assert {"e007", "e049"} <= got and not got & {"e050", "a"} and (most == 0 or len(got) == 2)
    assert known_events(store, ask, 0).count() == 0


def test_looking_up_ids_does_not_grow_with_the_log(spark, tmp_path):
    """Ids that grow with time: a batch of new ids reads nothing, one of old ids reads its own files, however long the log is."""
    from test_index import records_read

    store, read = Store(spark, str(tmp_path)), {}
    row = ingest.empty_log(spark)
    for k in range(12):
        ids = spark.range(1000, numPartitions=1).select(F.format_string(f"e{k:03d}-%05d", "id").alias("event_id"), F.lit("w").alias("workstream_id"))
        store.put("log", row.unionByName(ids, allowMissingColumns=True).coalesce(1).sortWithinPartitions("event_id"), k, ["workstream_id"], **{"parquet.bloom.filter.enabled#event_id": "true"})
        if k in (3, 11):
            for name, listed, ask in (("new", 2000, [f"e{k + 1:03d}-{i:05d}" for i in range(50)]), ("old", 2000, [f"e001-{i:05d}" for i in range(50)]), ("many new", 1, [f"e{k + 1:03d}-{i:05d}" for i in range(50)]), ("many old", 1, [f"e001-{i:05d}" for i in range(50)])):
                before, monkey = records_read(spark), pytest.MonkeyPatch()
                with monkey.context() as m:
                    m.setattr("eventloom.streaming.ingest.LISTED", listed)
                    assert known_events(store, spark.createDataFrame([(i,) for i in ask], "event_id string")).count() == (50 if "old" in name else 0)
                read[name, k] = records_read(spark) - before
    assert read["new", 3] == read["new", 11] == read["many new", 11] == 0
    assert read["old", 3] == read["old", 11] <= 1000 and read["many old", 3] == read["many old", 11] <= 1000


ENTRY = "session_id string, entry_id string, kind int, text string"


def feed(spark, tmp_path, parts, restart=True):
    source, seen = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, ENTRY).coalesce(1).write.mode("append").parquet(source)
        q = new_entries(spark.readStream.schema(ENTRY).parquet(source)).writeStream.format("parquet").option("path", seen).option("checkpointLocation", str(tmp_path / "ck"))
        q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(seen).collect()


def test_sessions_sent_again(spark, tmp_path):
    """Ranges are replayed, overlap and come out of order between sessions; the query is restarted from its checkpoint each time."""
    rng, offsets, want, parts = random.Random(4), {}, [], []
    for _ in range(4):
        part = []
        for s in ("a", "b", "c"):
            low = rng.randrange(8)
            part += [(s, f"{k:03d}", 0, "x") for k in range(low, low + rng.randrange(1, 5)) for _ in range(rng.randrange(1, 3))]
        rng.shuffle(part)
        parts.append(part)
        for s in ("a", "b", "c"):
            new = sorted({e for t, e, *_ in part if t == s and e > offsets.get(s, "")})
            want += [(s, e, new[0], new[-1]) for e in new]
            offsets[s] = new[-1] if new else offsets[s]
    got = feed(spark, tmp_path, parts)
    assert sorted((r["session_id"], r["entry_id"], r["from_entry"], r["to_entry"]) for r in got) == sorted(want)
