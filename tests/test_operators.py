import datetime as dt
import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from eventloom import adapter as A
from eventloom.functions import payloads, scoring, text
from eventloom.functions.redaction import redact_text
from eventloom.operators import bundle, consolidate, curation, dispatch, entities, evaluation, gates, ingest, maintenance, projections, scans, search, sessions, sync, textindex
from eventloom.sources import files

NOW = dt.datetime(2024, 2, 1)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_capability_denials():
    ok = gates.Token("u", "ws-1")
    assert gates.enforce(ok, NOW).workstream == "ws-1"
    for token, more in [
        (gates.Token("u", "ws-1", not_after=dt.datetime(2024, 1, 2)), {}),
        (ok, {"workstream": "ws-2"}),
        (gates.Token("u"), {}),
        (ok, {"channel": 1}),
        (gates.Token("u", "ws-1", categories=(1,)), {"categories": (2,)}),
    ]:
        with pytest.raises(gates.Denied):
            gates.enforce(token, NOW, **more)
    assert gates.enforce(gates.Token("u", cross=True), NOW).cross
    assert [gates.clamp_limit(n) for n in (-3, 7, 9999)] == [1, 7, 500]
    for bad in ("", "A", "a--b", "-a", "a" * 129):
        with pytest.raises(ValueError):
            gates.workstream_id(bad)


def test_null_principal_sees_nothing_private(spark):
    rows = spark.createDataFrame([("a", None, 0), ("b", "u", 0), ("c", None, None), ("d", "v", 1)], "event_id string, principal_id string, visibility int")
    assert [r[0] for r in rows.where(gates.visible("u")).orderBy("event_id").collect()] == ["b", "c", "d"]


def test_revocation_after_limit(spark, sf_dir):
    log, rev, vis = A.log(spark, sf_dir), A.revocations(spark, sf_dir), A.visibility(spark, sf_dir)
    cap = gates.enforce(gates.Token("user-8", "ws-1"), NOW)
    late = scans.structured_scan(log, rev, vis, cap, 100).count()
    first = scans.structured_scan(log, rev, vis, cap, 100, filter_first=True).count()
    assert late < first == 100


def test_sigmoid_regimes():
    assert [scoring.regime(n) for n in (0, 3, 4, 6, 7, 9, 10, 15, 16)] == [(15, -7), (15, -7), (10, -10), (10, -10), (8, -12), (8, -12), (6, -14), (6, -14), (4, -16)]


def test_recency_is_e_folding(spark):
    at = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    assert one(spark, scoring.recency(at, "2024-02-01 00:00:00")) == pytest.approx(0.36787944)
    assert one(spark, scoring.recency(at, "2024-02-01 00:00:00", 0)) == 1.0


def test_cosine(spark):
    a, z, b = (F.array(*[F.lit(float(v)) for v in x]) for x in ((1, 0), (0, 0), (-1, 0)))
    assert one(spark, scoring.cosine(a, a)) == 1.0
    assert one(spark, scoring.cosine(a, z)) == one(spark, scoring.cosine(a, b)) == 0.0
    with pytest.raises(Exception, match="unequal"):
        one(spark, scoring.cosine(a, F.array(F.lit(1.0))))


def test_subject_keys(spark):
    assert one(spark, text.subject_key(F.lit("  User3's   Team "))) == "user3 team"
    assert one(spark, text.subjects(F.lit("What did Melanie's cat and John do? Melanie"))) == ["melanie", "john"]


@pytest.mark.parametrize("kind,raw,want", [("email", " A.B@GMail.com ", "ab@gmail.com"), ("email", "a.b@x.org", "a.b@x.org"), ("email", "@x", ""), ("login", " Bob ", "bob"), ("slack", " U1 ", "U1"), ("name", "Bob", ""), ("url", "HTTPS://Ex.com:443/a/?q=1", "https://ex.com/a?q=1"), ("url", "http://ex.com", "http://ex.com/"), ("url", "http://ex.com:8080/", "http://ex.com:8080/"), ("url", "nonsense", "")])
def test_canonical(spark, kind, raw, want):
    assert one(spark, text.canonical_entity(F.lit(kind), F.lit(raw))) == want


def test_entity_id_byte_order(spark):
    h = bytearray(hashlib.sha1(b"eventloom:entity:ws:0:ab@gmail.com").digest()[:16])
    h[6], h[8] = (h[6] & 0x0F) | 0x50, (h[8] & 0x3F) | 0x80
    assert one(spark, text.entity_id(F.lit("ws"), F.lit(0), F.lit("ab@gmail.com"))) == "ent-" + uuid.UUID(bytes_le=bytes(h)).hex


@pytest.mark.parametrize("body,want", [("", ("", 0)), ("nothing here", ("nothing here", 0)), ("key sk-" + "a" * 24 + " end", ("key <REDACTED:openai-key> end", 1)), ("AKIA" + "A1" * 8, ("<REDACTED:aws-access-key>", 1)), ("akia" + "a1" * 8, ("akia" + "a1" * 8, 0)), ("x password=hunter22;y", ("x <REDACTED:connection-string-password>;y", 1)), ("Bearer abcdefghijkl==", ("<REDACTED:bearer-token>", 1)), (None, ("", 0))])
def test_redaction(body, want):
    assert redact_text(body) == want


@pytest.mark.parametrize("body,hit,category,want", [("", False, 1, 0), ("x", True, 1, 3), ("me@x.org", False, 1, 4), ("ssn 123-45-6789", False, 1, 4), ("do not share", False, 1, 2), ("plain", False, 0, 0), ("plain", False, 2, 1)])
def test_classifier(spark, body, hit, category, want):
    assert one(spark, text.classify(F.lit(body), F.lit(hit), F.lit(category))) == want


@pytest.mark.parametrize("body,want", [("hello there, my good friend", "dropped"), ("short", "dropped"), ("we will go with plan B now", "decision"), ("the fix was merged today ok", "outcome"), ("I want to learn to sail soon", "goal"), ("the sky over Paris was grey", "fact"), ("   ", None)])
def test_cues(spark, body, want):
    assert one(spark, text.cue(F.lit(body))) == want


def test_chain_takes_last_action_and_its_outcome(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("d", 2, 0, None, None, None), ("a1", 5, 1, "d", None, None), ("a2", 5, 2, "d", None, None), ("o1", 6, 3, None, "a1", 1), ("a3", 5, 4, "ghost", None, None), ("o3", 6, 5, None, "a3", -1)]
    log = spark.createDataFrame([(i, "w", c, t + dt.timedelta(days=n), t + dt.timedelta(days=n), d, a, p) for i, c, n, d, a, p in rows], "event_id string, workstream_id string, category int, created_at timestamp_ntz, valid_at timestamp_ntz, decision_ref string, action_ref string, polarity int")
    got = {r["decision_id"]: (r["action_id"], r["outcome_id"], r["closed"], r["decision_at"].day) for r in projections.decision_chains(log).collect()}
    assert got == {"d": ("a2", None, False, 1), "ghost": ("a3", "o3", True, 5)}


def test_packing_goes_on_after_overflow(spark):
    t = dt.datetime(2024, 1, 1)
    body = [("e1", "a" * 196, 0.9), ("e2", "b" * 196, 0.8), ("e3", "c" * 196, 0.7), ("e4", "d" * 196, 0.6), ("e5", "short", 0.5)]
    events = spark.createDataFrame([("w", i, 1, t, x, s) for i, x, s in body], "workstream_id string, event_id string, category int, valid_at timestamp_ntz, text string, score double")
    got = {r["event_id"]: r["fits"] for r in bundle.packed(events, 1600).collect()}
    assert got == {"e1": True, "e2": True, "e3": True, "e4": False, "e5": True}
    assert bundle.hints(events, 1600).count() == sum(not v for v in got.values())


def test_curation_hash_guards(spark, sf_dir):
    log, cur = A.log(spark, sf_dir), A.curations(spark, sf_dir)
    state = curation.target_state(log, cur).limit(1).collect()[0]
    new = spark.createDataFrame([(state["target_id"], state["hash"]), (state["target_id"], "X"), ("nobody", None)], "target_id string, expected_hash string")
    good, bad = curation.appended(cur, new, log)
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["stale", "unknown target"]
    with pytest.raises(NotImplementedError):
        curation.split_facts()


def test_review_decisions(spark):
    rows = spark.createDataFrame([("a", "pending"), ("b", "approved"), ("c", "deferred")], "event_id string, status string").withColumn("defer_until", F.lit(None).cast("timestamp_ntz"))
    done = spark.createDataFrame([("a", "approve"), ("b", "reject"), ("c", "defer")], "event_id string, action string").withColumn("until", F.lit("2024-03-01").cast("timestamp_ntz"))
    got = {r["event_id"]: (r["status"], r["defer_until"] is not None) for r in curation.decided(rows, done).collect()}
    assert got == {"a": ("approved", False), "b": ("approved", False), "c": ("deferred", True)}


def test_sync_converges(spark, sf_dir):
    log = A.log(spark, sf_dir).select("event_id", "statement")
    a, b = log.where("hash(event_id) % 2 = 0"), log.where("hash(event_id) % 3 = 0")
    ab, ba = sync.union(a, b), sync.union(b, a)
    assert ab.count() == ab.distinct().count() == ba.count() == sync.union(ab, b).count()
    assert ab.exceptAll(ba).count() == 0


def test_tier_two(spark):
    known = spark.createDataFrame([("w", "name", "e1", 5, 1, [1.0, 0.0]), ("w", "name", "e2", 9, 1, [0.0, 1.0])], "workstream_id string, kind string, entity_id string, mention_count int, last_seen int, v array<double>")
    new = spark.createDataFrame([("n1", "w", "name", [1.0, 0.1]), ("n2", "w", "name", [1.0, 1.0])], "new_id string, workstream_id string, kind string, v array<double>")
    assert [(r["new_id"], r["entity_id"]) for r in entities.nearest_entities(new, known).collect()] == [("n1", "e1")]


def test_accuracy_and_percentile(spark):
    graded = spark.createDataFrame([(1, True, 10.0), (1, False, 20.0), (5, False, 30.0)], "category int, correct boolean, tokens double")
    got = {r["part"]: (r["total"], r["right"]) for r in evaluation.accuracy(graded).collect()}
    assert got == {"1": (2, 1), "5": (1, 0), "all": (3, 1), "all but 5": (2, 1)}
    values = spark.createDataFrame([(0, v) for v in range(1, 11)], "k int, v int")
    assert evaluation.percentile(values, "k", "v", 50).first()["p50"] == 5


FACT = '{"$type":"fact","statement":"%s","supportingEvents":[]}'


def captures(spark, body):
    rows = spark.createDataFrame(body, "event_id string, workstream_id string, channel int, category int, principal_id string, payload string")
    return rows.withColumn("valid_at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("recorded_at", F.col("valid_at")).withColumn("source", F.lit("t")).withColumn("schema_version", F.lit(1))


def test_ingest_twice_is_once(spark):
    body = [("e1", "ws-1", 0, 1, "u", FACT % "call me@x.org"), ("e1", "ws-1", 0, 1, "u", FACT % "again"), ("e2", "BAD", 0, 1, "u", FACT % "x"), ("e3", "ws-1", 0, 1, "u", FACT % ("token sk-" + "a" * 30)), ("e4", "ws-1", 0, 1, "u", '{"$type":"odd"}'), ("e5", "ws-1", 0, 1, "u", "no json")]
    good, bad = ingest.validated(captures(spark, body))
    assert {r["event_id"]: r["reason"] for r in bad.collect()} == {"e2": "not a workstream id", "e4": "not a payload", "e5": "not a payload"}
    first = ingest.new_rows(ingest.prepared(good, "2024-02-01 00:00:00"), ingest.empty_log(spark))
    got = {r["event_id"]: (r["classification"], json.loads(r["payload"])["statement"]) for r in first.collect()}
    assert got == {"e1": (1, "again"), "e3": (3, "token <REDACTED:openai-key>")}  # of equal stamps the first payload in order
    assert ingest.new_rows(ingest.prepared(good, "2024-02-01 00:00:00"), first).count() == 0
    assert {r["event_id"]: r["visibility"] for r in ingest.sidecar_visibility(first).collect()} == {"e1": 1, "e3": 0}
    assert {r["event_id"] for r in ingest.outbox(first).collect()} == {"e1", "e3"}


def test_payload_redaction_by_field(spark):
    key = "sk-" + "a" * 30
    rows = [
        ({"$type": "fact", "statement": key, "triples": [{"subject": key, "predicate": "p", "object": "o"}]}, 2),
        ({"$type": "decision", "statement": "s", "rationale": key, "approver": key}, 1),
        ({"$type": "action", "statement": key, "externalReference": key}, 2),
        ({"$type": "skill", "name": key, "procedure": key, "trigger": None}, 2),
        ({"$type": "evidence", "content": "plain", "source": key}, 0),
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(rows)], "i int, j string")
    got = {r["i"]: r["r"] for r in df.select("i", payloads.redacted(payloads.parsed(F.col("j"))).alias("r")).collect()}
    mark = "<REDACTED:openai-key>"
    assert [got[i]["hits"] for i in range(5)] == [n for _, n in rows]
    assert got[0]["payload"]["statement"] == mark and got[0]["payload"]["triples"][0]["subject"] == mark and got[0]["payload"]["triples"][0]["predicate"] == "p"
    assert got[1]["payload"]["rationale"] == mark and got[1]["payload"]["approver"] == key and got[3]["payload"]["trigger"] is None and got[4]["payload"]["source"] == key


def test_streams(spark, tmp_path):
    from eventloom import schema as S
    from eventloom.streaming.ingest import Store, new_entries, start_ingest

    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(f"e{i % 7}", "ws-1", 0, 1, None, None, "u", "t", FACT % "plain words", 1) for i in range(10)] + [("bad", "ws-1", 0, 1, None, None, "u", "t", "no json", 1)], S.CAPTURE)
    for part in range(2):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(S.CAPTURE).parquet(source)
        start_ingest(stream, store, str(tmp_path / "ck"), lambda: "2024-02-01 00:00:00", reviewed=["ws-1"]).trigger(availableNow=True).start().awaitTermination()
    assert store.log().count() == 7
    assert spark.read.parquet(store.path("visibility")).count() == 7 == spark.read.parquet(store.path("outbox")).count()
    assert spark.read.parquet(store.path("rejects")).count() == 2

    entries, seen = str(tmp_path / "entries"), str(tmp_path / "seen")
    ddl = "session_id string, entry_id string, kind int, text string"
    for ids in (("001", "002"), ("002", "003")):
        spark.createDataFrame([("s", i, 0, "x") for i in ids], ddl).coalesce(1).write.mode("append").parquet(entries)
        q = new_entries(spark.readStream.schema(ddl).parquet(entries)).writeStream.format("parquet").option("path", seen).option("checkpointLocation", str(tmp_path / "ck2"))
        q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["entry_id"] for r in spark.read.parquet(seen).collect()) == ["001", "002", "003"]


def test_sessions(spark):
    facts = spark.createDataFrame([(0, 0, ["a"]), (0, 1, ["b", "c"])], "chunk int, fact_no int, support array<string>")
    triples = spark.createDataFrame([(0, "t1", ["b"]), (0, "t2", ["z"])], "chunk int, triple_id string, support array<string>")
    assert {r["triple_id"]: r["fact_no"] for r in sessions.attach_triples(triples, facts).collect()} == {"t1": 1, "t2": 0}


def test_files(spark, tmp_path):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "event_id string, n int")
    files.write_snapshot({"event": t, "other": t.limit(1)}, str(tmp_path / "snap"))
    back = files.read_snapshot(spark, str(tmp_path / "snap"), {"event": "event_id string, n int"})
    assert files.content_key(back["event"]) == files.content_key(t)
    (tmp_path / "c.json").write_text('[{"sample_id": "s", "conversation": {"session_1": [{"speaker": "A", "text": "hi"}], "session_1_date_time": "1:56 pm on 8 May, 2023", "session_2": [{"speaker": "B", "text": "yo"}]}, "qa": [{"question": "q", "adversarial_answer": "z", "category": 5}]}]')
    turns, questions = files.chat_corpus(spark, str(tmp_path / "c.json"))
    assert {r["session"]: r["at"] for r in turns.collect()} == {1: dt.datetime(2023, 5, 8, 13, 56), 2: dt.datetime(2023, 1, 3)}
    assert questions.first()["answer"] == "z"
    (tmp_path / "r.jsonl").write_text('{"sample_id": "s", "question": "q", "n": 1}\n{"sample_id": "s", "question": "q", "n": 2}\n{"samp')
    assert [r["n"] for r in files.resumed(spark, str(tmp_path / "r.jsonl"), "sample_id string, question string, n int").collect()] == [2]


# ---- text search ----


@pytest.mark.parametrize("word,query", [("Šárka řekla", "sarka"), ("ΆΛΦΑ βήτα", "Αλφα"), ("ЁЛКА", "елка"), ("Crème Brûlée", "CREME"), ("ŐZ fut", "őz")])
def test_one_normal_form(spark, word, query):
    assert one(spark, text.terms(F.lit(word)))[0] == text.query_terms(query)[0] == text.query_terms(word)[0]


def small_store(spark):
    """Five events about Melanie: shared, private of the viewer, private of another, revoked, of another workstream."""
    t = dt.datetime(2024, 1, 1)
    body = [("e1", "w", "u", 1, "melanie paints a sunrise", 1), ("e2", "w", "u", 1, "melanie paints horses", 0), ("e3", "w", "v", 1, "melanie paints secrets", 0), ("e4", "w", "u", 1, "melanie paints doors", 1), ("e5", "x", "u", 1, "melanie paints far away", 1), ("e6", "w", "u", 2, "nothing to do with it", 1)]
    log = spark.createDataFrame([(i, w, p, c, 0, t, t, None, s, None) for i, w, p, c, s, _ in body], "event_id string, workstream_id string, principal_id string, category int, event_channel int, created_at timestamp_ntz, valid_at timestamp_ntz, invalid_at timestamp_ntz, statement string, skill_name string")
    gone = spark.createDataFrame([("e4", t)], "event_id string, revoked_at timestamp_ntz")
    seen = spark.createDataFrame([(i, v) for i, *_, v in body], "event_id string, visibility int")
    corpus = log.withColumnRenamed("statement", "content")
    return search.Events(log, gone, seen), textindex.indexed(corpus), corpus


def test_free_text_passes_every_gate(spark):
    events, index, _ = small_store(spark)
    token = gates.Token("u", "w")
    run = lambda token, **more: {r["event_id"] for r in dispatch.run(dispatch.Sources(events, index), token, dispatch.Request("melanie paints", **more), NOW).items.collect()}
    assert run(token) == {"e1", "e2"}
    assert run(gates.Token("v", "w")) == {"e1", "e3"}
    assert run(token, categories=(2,)) == set()
    assert run(token, bounds=search.Bounds(principal="u")) == {"e1", "e2"} and run(token, bounds=search.Bounds(as_of="2023-12-31 00:00:00")) == set()
    assert run(token, bounds=search.Bounds(since="2024-01-02 00:00:00")) == set()
    scan = dispatch.run(dispatch.Sources(events, index), gates.Token("u", cross=True), dispatch.Request("melanie", explain=True), NOW)
    assert scan.dispatcher == "structured" and {r["event_id"] for r in scan.items.collect()} == {"e1", "e2", "e5", "e6"}
    with pytest.raises(gates.Denied):
        run(gates.Token("u", "other"), workstream="w")


def test_subjects_boost_and_come_in(spark):
    events, index, _ = small_store(spark)
    triples = spark.createDataFrame([("w", "e1", "melanie", "paints", "sunrise", dt.datetime(2024, 1, 1)), ("w", "e6", "melanie", "rests", "here", dt.datetime(2024, 1, 2)), ("w", "e3", "melanie", "keeps", "secrets", dt.datetime(2024, 1, 3))], "workstream_id string, event_id string, subject_key string, predicate string, object string, valid_at timestamp_ntz")
    vectors = spark.createDataFrame([("e1", "p", [1.0, 0.0]), ("e2", "p", [0.0, 1.0])], "event_id string, provider_id string, embedding array<double>")
    embed = lambda _t: spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    sources = dispatch.Sources(events, index, vectors, "p", embed, triples, subject_boost=True)
    out = dispatch.run(sources, gates.Token("u", "w"), dispatch.Request("What does Melanie paint?", "w", limit=5, supplement=True, explain=True), NOW)
    got = {r["event_id"]: r["score"] for r in out.items.collect()}
    assert set(got) == {"e1", "e2", "e6"} and got["e6"] == pytest.approx(0.2) and max(got, key=got.get) == "e1"
    assert {r["object"] for r in out.triples.collect()} == {"sunrise", "here"} and out.explain.first()["dispatcher"] == "hybrid"
    plain = dispatch.run(dispatch.Sources(events, index, vectors, "p", embed, triples), gates.Token("u", "w"), dispatch.Request("What does Melanie paint?", "w", limit=5), NOW)
    assert "e6" not in {r["event_id"] for r in plain.items.collect()}


def test_reranker_sees_a_wider_pool(spark):
    events, index, _ = small_store(spark)
    assert [dispatch.retrieve_limit(n, r) for n, r in ((10, True), (10, False), (400, True), (9999, True))] == [150, 10, 400, 500]
    last_first = lambda _t, items: items.select("event_id", F.substring("event_id", 2, 1).cast("double").alias("score"))
    out = dispatch.run(dispatch.Sources(events, index, rerank=last_first), gates.Token("u", "w"), dispatch.Request("melanie paints", limit=1), NOW)
    assert out.dispatcher == "lexical+rerank" and [r["event_id"] for r in out.items.collect()] == ["e2"]


def test_index_upsert(spark):
    _, index, corpus = small_store(spark)
    new = corpus.where("event_id = 'e1'").withColumn("content", F.lit("melanie sleeps"))
    after = textindex.upserted(index, new, replaced=True)
    assert {r["term"] for r in after.postings.where("event_id = 'e1'").collect()} == {"melanie", "sleeps"}
    total = after.sizes.agg(F.sum("n"), F.sum("words")).first()
    assert total[0] == 6 and total[1] == index.sizes.first()["words"] - 2
    assert textindex.bm25(after, "").count() == 0


# ---- bundles, sessions, entities, review, consolidation, sync ----


def test_bundles_are_cached_until_stale(spark, sf_dir):
    log, cur = A.log(spark, sf_dir), A.curations(spark, sf_dir)
    events = bundle.scored_events(log, A.revocations(spark, sf_dir), cur, A.NOW)
    empty = spark.createDataFrame([], bundle.BUNDLE)
    first, cache = bundle.served(empty, events, log, cur, "2100-01-01 00:00:00")
    cache = spark.createDataFrame(cache.collect(), empty.schema)
    assert first.count() == cache.count() == 5 and all(len(r["sections"]) > 3 and r["token_count"] > 500 for r in cache.collect())
    again, _ = bundle.served(cache, events, log, cur, "2100-01-02 00:00:00")
    assert {r["generated_at"].day for r in again.collect()} == {1}
    old = cache.withColumn("covered_through", F.when(F.col("workstream_id") == "ws-1", F.lit("x")).otherwise(F.col("covered_through")))
    mixed, after = bundle.served(old, events, log, cur, "2100-01-02 00:00:00")
    assert {r["workstream_id"]: r["generated_at"].day for r in mixed.collect()} == {f"ws-{i}": 2 if i == 1 else 1 for i in range(5)} and after.count() == 5
    assert {r["generated_at"].day for r in bundle.served(cache, events, log, cur, "2100-01-02 00:00:00", refresh=True)[0].collect()} == {2}
    prior = cache.where("workstream_id = 'ws-1'")
    noted = events.where("workstream_id = 'ws-1'").orderBy("event_id").limit(1).select(F.lit("c").alias("curation_id"), F.col("event_id").alias("target_id"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("multiplier"), F.lit(None).cast("string").alias("new_content"), F.lit("2024-01-05").cast("timestamp_ntz").alias("occurred_at"), F.lit(False).alias("reverted"), F.lit("ann").alias("curator"), F.lit("since it is so").alias("rationale"))
    told = bundle.prompt(events, noted, 4096, A.NOW, scans.latest(log), prior).where("workstream_id = 'ws-1'").first()["prompt"]
    assert told.startswith(f"Workstream: ws-1\nGenerated at: {A.NOW}\nToken budget: 4096\nEvents covered through: {prior.first()['covered_through']}\n\n== Decision (")
    assert told.count("- [ev-") == events.where("workstream_id = 'ws-1'").count() and "    * Annotate by ann: since it is so" in told and told.endswith(prior.first()["orientation"])


def test_bundle_packing_by_brute_force(spark, sf_dir):
    events = bundle.scored_events(A.log(spark, sf_dir), A.revocations(spark, sf_dir), A.curations(spark, sf_dir), A.NOW)
    got = {r["event_id"]: r["fits"] for r in bundle.packed(events).collect()}
    groups = {}
    for r in sorted(events.collect(), key=lambda r: (-r["score"], -r["valid_at"].timestamp(), r["event_id"])):
        groups.setdefault((r["workstream_id"], r["category"]), []).append(r)
    for rows in groups.values():
        used = 0
        for r in rows:
            line = f"- {r['text'] if len(r['text']) <= 200 else r['text'][:200] + '…'} [{r['event_id']}]"
            tokens = (len(line) + 3) // 4
            assert got[r["event_id"]] == (used + tokens <= 512)
            used += tokens if got[r["event_id"]] else 0


def test_session_run(spark):
    t = dt.datetime(2024, 1, 1)
    said = ["we will go with plan B now", "hello there, my good friend", "the sky over Paris was grey"]
    entries = spark.createDataFrame([("s", f"{i:03d}", t + dt.timedelta(minutes=i), 0, x) for i, x in enumerate(said)], "session_id string, entry_id string, entry_at timestamp_ntz, kind int, text string")
    marks, runs = spark.createDataFrame([], "session_id string, last_entry string"), spark.createDataFrame([], "session_id string, from_entry string, to_entry string")
    home = spark.createDataFrame([("s", "w", "u")], "session_id string, workstream_id string, principal_id string")
    out = sessions.distil_run(entries, marks, runs, home, "2024-02-01 00:00:00")
    made = {r["category"]: r for r in out["captures"].collect()}
    assert set(made) == {1, 2} and made[2]["first_entry"] == made[2]["last_entry"] == "000" and made[2]["valid_at"] == t and out["dropped"].count() == 1
    good, bad = ingest.validated(out["captures"].select("event_id", "workstream_id", "channel", "category", "valid_at", "recorded_at", "principal_id", "source", "payload", "schema_version"))
    assert good.count() == 2 and bad.count() == 0
    mark, run = out["watermarks"].collect(), out["runs"].collect()
    assert mark[0]["last_entry"] == "002" and run[0]["n_events"] == 2
    marks = spark.createDataFrame([("s", "002")], "session_id string, last_entry string")
    assert sessions.distil_run(entries, marks, runs, home, "2024-02-01 00:00:00")["captures"].count() == 0
    runs = spark.createDataFrame([("s", "000", "002")], "session_id string, from_entry string, to_entry string")  # the watermark was lost, the run was not
    assert sessions.distil_run(entries, spark.createDataFrame([], "session_id string, last_entry string"), runs, home, "2024-02-01 00:00:00")["captures"].count() == 0
    own = lambda tail: tail.groupBy("session_id").agg(F.array_sort(F.collect_list("entry_id")).alias("supporting")).select("session_id", "supporting", F.lit(4).alias("category"), F.lit("be calm").alias("statement"), F.lit(None).cast("timestamp_ntz").alias("valid_at"))
    r = sessions.distil_run(entries, marks.where("false"), runs.where("false"), home, "2024-02-01 00:00:00", own, "host")["captures"].first()
    assert (r["first_entry"], r["last_entry"], r["source"], r["valid_at"].minute) == ("000", "002", "session/host", 2)


def test_entities_in_three_tiers(spark):
    known = entities.resolved(spark.createDataFrame([("w", "email", "a@x.org")], "workstream_id string, kind string, raw string")).withColumn("mention_count", F.lit(3)).withColumn("last_seen", F.lit(1)).withColumn("v", F.array(F.lit(1.0), F.lit(0.0))).withColumn("display_name", F.lit("Ann"))
    name = spark.createDataFrame([("w", "name", "Bob", "n-bob", 9, 1, [0.0, 1.0], "", "Bob")], "workstream_id string, kind string, raw string, entity_id string, mention_count int, last_seen int, v array<double>, canonical string, display_name string")
    known = known.unionByName(name)
    new = spark.createDataFrame([("1", "w", "email", "A@X.org", None), ("2", "w", "name", "Bobby", [0.01, 1.0]), ("3", "w", "name", "Carl", [1.0, 0.0])], "new_id string, workstream_id string, kind string, raw string, v array<double>")
    got = {r["new_id"]: (r["tier"], r["entity_id"]) for r in entities.resolve(new, known).collect()}
    assert got["1"][0] == 1 and got["2"] == (2, "n-bob") and got["3"] == (0, "3")
    pairs = entities.candidate_pairs(new.where("new_id = '3'"), known)
    judge = lambda b: b.assign(confidence=[0.7] * len(b), rationale=["alike"] * len(b))
    open_ = entities.proposals(pairs, judge, "host", "2024-02-01 00:00:00")
    assert entities.proposals(pairs, lambda b: b.assign(confidence=[0.4] * len(b), rationale=[""] * len(b)), "host", "2024-02-01 00:00:00").count() == 0
    open_ = spark.createDataFrame(open_.collect(), open_.schema)
    (p,) = open_.collect()
    yes = spark.createDataFrame([(p["proposal_id"], "confirm")], "proposal_id string, action string")
    same, changed = (spark.createDataFrame([("n-bob", h)], "entity_id string, hash string") for h in (p["winner_state_hash"], "X"))
    after, merges, refused = entities.proposals_decided(open_, yes, same)
    assert after.first()["status"] == "confirmed" and [r["loser_id"] for r in merges.collect()] == ["3"] and refused.count() == 0
    assert [r["reason"] for r in entities.proposals_decided(after, yes, same)[2].collect()] == ["not open"]
    assert [r["reason"] for r in entities.proposals_decided(open_, yes, changed)[2].collect()] == ["stale"]


def test_reverts(spark):
    t = dt.datetime(2024, 1, 1)
    cur = spark.createDataFrame([("c1", "e", 0, "u", t, False), ("c2", "e", 1, "u", t, True), ("c3", "e", 4, "u", t, False)], "curation_id string, target_id string, kind int, curator string, occurred_at timestamp_ntz, reverted boolean")
    asked = spark.createDataFrame([(c, "v", t) for c in ("c1", "c2", "c3", "c9")], "curation_id string, curator string, occurred_at timestamp_ntz")
    after, refused = curation.reverted(cur, asked)
    assert {r["curation_id"]: (r["kind"], r["reverted"]) for r in after.collect()} == {"c1": (0, True), "c2": (1, True), "c3": (4, False), "rev-c1": (4, False)}
    assert {r["curation_id"]: r["reason"] for r in refused.collect()} == {"c2": "already reverted", "c3": "a revert is not reverted", "c9": "unknown curation"}


def test_review_run(spark):
    rows = spark.createDataFrame([(i, "w", s) for i, s in (("a", "pending"), ("b", "deferred"), ("c", "pending"), ("d", "approved"), ("e", "approved"))], "event_id string, workstream_id string, status string").withColumn("defer_until", F.lit(None).cast("timestamp_ntz"))
    said = [("a", "approve", None), ("b", "reject", "wrong"), ("c", "reject", " "), ("d", "approve", None), ("e", "defer", None), ("z", "approve", None)]
    done = spark.createDataFrame([(i, a, r, "u") for i, a, r in said], "event_id string, action string, reason string, principal_id string").withColumn("until", F.lit("2024-03-01").cast("timestamp_ntz"))
    out = curation.review_run(rows, done, "2024-02-01 00:00:00")
    assert {r["event_id"]: r["status"] for r in out["reviews"].collect()} == {"a": "approved", "b": "rejected", "c": "pending", "d": "approved", "e": "approved"}
    assert {r["source"] for r in out["audit"].collect()} == {"event.review_approved", "event.review_rejected"} and out["audit"].where("event_channel = 1").count() == 2
    assert [r["event_id"] for r in out["approved"].collect()] == ["a"] and [r["event_id"] for r in out["revocations"].collect()] == ["b"]
    assert {r["event_id"]: r["reason"] for r in out["refused"].collect()} == {"c": "a rejection needs a reason", "e": "already decided", "z": "not in review"}


def test_revocations(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("a", "x1"), ("b", None)], "event_id string, artifact_id string")
    had = spark.createDataFrame([("a", t)], "event_id string, revoked_at timestamp_ntz")
    new = spark.createDataFrame([("a", t + dt.timedelta(1)), ("b", t), ("z", t)], "event_id string, revoked_at timestamp_ntz")
    assert {r["event_id"]: (r["revoked_at"], r["first"]) for r in ingest.revocation_stamps(new, had, log).collect()} == {"a": (t, False), "b": (t, True)}
    assert {r["event_id"] for r in ingest.revoked(had, new, log).collect()} == {"b"}
    bodies = ingest.tombstones(spark.createDataFrame([("x1", b"1"), ("x2", b"2")], "artifact_id string, body binary"), had, log)
    assert {r["artifact_id"]: r["body"] is None for r in bodies.collect()} == {"x1": True, "x2": False} and ingest.is_revoked(had, "a") and not ingest.is_revoked(had, "b")


def test_dream_run(spark, sf_dir):
    log, rev, vis = A.log(spark, sf_dir), A.revocations(spark, sf_dir), A.visibility(spark, sf_dir)
    inputs = consolidate.dream_inputs(log, rev, vis, "user-8", "ws-1", 40)

    def dreamer(rows):
        rows = rows.sort_values("event_id").head(2)
        return rows.assign(output_id=rows["event_id"] + "-o", category=1, statement="dreamt " + rows["event_id"], sources=[[e] for e in rows["event_id"]], proposed=2)[["output_id", "workstream_id", "category", "statement", "sources", "proposed"]]

    out = consolidate.dream_run(inputs, dreamer, "output_id string, workstream_id string, category int, statement string, sources array<string>, proposed int", log, "2024-02-01 00:00:00")
    good, bad = ingest.validated(out["captures"])
    assert good.count() == 2 and bad.count() == 0 and out["audit"].first()["n_inputs"] == 40 and {r["visibility"] for r in out["visibility"].collect()} <= {0, 2}
    assert consolidate.dream_skills(projections.skills(log, rev), rev, vis, log, "user-8", "ws-1").count() > 0


def test_snapshot_store(spark, tmp_path):
    store = files.SnapshotStore(spark, str(tmp_path))
    events = spark.createDataFrame([("a", 1), ("b", None)], "event_id string, n int")
    other = spark.createDataFrame([("c1", "e")], "curation_id string, target_id string")
    name, new = store.push("w", {"event": events, "curation": other})
    assert new and store.push("w", {"curation": other, "event": events.orderBy(F.desc("event_id"))}) == (name, False) and store.names("w") == [name] and store.names("x") == []
    assert store.push("w", {"event": events.limit(1), "curation": other})[0] != name and len(store.names("w")) == 2
    local = {"event": events.where("event_id = 'b'"), "curation": other.where("false")}
    once = store.pull_all("w", local, {"event": "event_id", "curation": "curation_id"})
    assert once["event"].count() == 2 and once["curation"].count() == 1 and store.pull_all("w", once, {"event": "event_id", "curation": "curation_id"})["event"].count() == 2
    assert files.wiped(spark, str(tmp_path)) and store.names("w") == []


def test_small_pieces(spark, tmp_path):
    assert one(spark, text.model_label(F.lit(" confidential, I think"), F.lit(1))) == 2 and one(spark, text.model_label(F.lit("unsure"), F.lit(1))) == 1 and one(spark, text.model_label(F.lit(None).cast("string"), F.lit(4))) == 4
    early, late = (one(spark, text.time_id(F.lit(d).cast("timestamp_ntz"), F.lit("x"))) for d in ("2024-01-01", "2024-01-02"))
    assert len(early) == 26 and early < late and early[10:] == late[10:] and one(spark, text.content_id("e-", F.lit("x"))).startswith("e-")
    assert [one(spark, text.answer_text(F.parse_json(F.lit(j)))) for j in ("true", "false", "12", '"a"', "null", '"true"', '"null"', '"1.50"', "1.50", '["a"]')] == ["yes", "no", "12", "a", "null", "true", "null", "1.50", "1.5", '["a"]']
    assert one(spark, text.answer_text(F.lit(None).cast("variant"))) is None
    assert evaluation.retried(lambda n: "don't know" if n < 30 else "yes", 10, lambda a: "know" in a) == ("yes", 30)
    assert evaluation.planned("q", lambda q: (["a", " ", "b", "c", "d"], "made up")) == ["q", "a", "b", "made up"] and evaluation.planned("q", lambda q: 1 / 0) == ["q"]
    vectors = maintenance.hashed_embedding(spark.createDataFrame([("a", ["x", "y", "x"]), ("b", [])], "event_id string, t array<string>"), "t", 16)
    got = {r["event_id"]: r["embedding"] for r in vectors.collect()}
    assert sum(v * v for v in got["a"]) == pytest.approx(1) and got["b"] == [0.0] * 16
    assert [r[0] for r in files.markdown(spark.createDataFrame([("a|b", 1)], "x string, y int")).collect()] == ["| x | y |", "|-|-|", "| a\\|b | 1 |"]
    entries = spark.createDataFrame([('[{"entry_id":"1","timestamp":"2024-01-01T00:00:00Z","kind":"toolcall","text":"t"}]',)], "body string")
    assert files.entry_array(entries).first()["kind"] == 3
    for wrong in ('[{"entry_id":"1","timestamp":"2024-01-01T00:00:00Z","kind":"odd","text":"t"}]', '[{"entry_id":"1","kind":"ToolCall","text":"t"}]'):
        with pytest.raises(Exception, match="entr"):
            files.entry_array(spark.createDataFrame([(wrong,)], "body string")).collect()
    calls = []
    got = maintenance.embedded(spark.range(130).select(F.col("id").cast("string").alias("event_id"), F.lit("t").alias("text")).coalesce(1), lambda xs: [[float(len(xs))]] * len(xs), "p").collect()
    assert max(r["embedding"][0] for r in got) == 64.0 and not calls
    assert maintenance.weight_of(spark.createDataFrame([("a", 2.0)], "event_id string, weight double"), spark.createDataFrame([("a",), ("b",)], "event_id string")).agg(F.sum("weight")).first()[0] == 3.0
    failed = maintenance.processing_log(spark.createDataFrame([("a", 2)], "event_id string, category int"), spark.createDataFrame([("a", "decisions", "boom")], "event_id string, projection string, error string"))
    assert {r["projection"]: r["status"] for r in failed.collect()} == {"decisions": "Failed", "decision_chains": "Applied"}
