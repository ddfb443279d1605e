"""Runs that compose several operators: subject pass, fleet, conversation benchmark, kept state; percentiles with outliers; small sources and sinks."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom import adapter as A
from eventloom.functions import text
from eventloom.operators import bundle, consolidate, entities, evaluation, gates, ingest, maintenance, scans
from eventloom.sources import files
from eventloom.streaming.state import Kept

T0 = dt.datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_percentile_with_an_outlier(spark):
    """One value of 10^12 among 6,400: ranges stay even, results exact, null keys and repeated values too."""
    rows = [("a", float(i)) for i in range(6400)] + [("a", 1e12), ("b", 5.0), (None, 2.0), (None, 1.0)] + [("c", 7.0)] * 50 + [("c", 9.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    for p in (1, 50, 95, 100):
        want = {}
        for k in {k for k, v in rows if v is not None}:
            values = sorted(v for x, v in rows if x == k and v is not None)
            want[k] = values[max(1, len(values) * p // 100) - 1]
        assert {r["k"]: r[f"p{p}"] for r in evaluation.percentile(df, "k", "v", p).collect()} == want
    known = df.where("v is not null").withColumnRenamed("k", "k").select("k", "v")
    ends = known.groupBy("k").agg(F.percentile_approx("v", [i / evaluation.RANGES for i in range(1, evaluation.RANGES)], evaluation.SKETCH).alias("cuts"))
    sizes = evaluation.ranged(known.withColumn("c", F.lit(1)), ends).where("k = 'a'").groupBy("r").count()
    assert sizes.agg(F.max("count")).first()[0] <= 6401 * 0.04


def test_subject_pass(spark):
    triples = spark.createDataFrame([("w", "e2", "ann", "p", None), ("w", "e1", "ann", "q", None), ("w", "e3", "bob", "p", "had"), ("x", "e4", "ann", "p", None)], "workstream_id string, event_id string, subject_key string, predicate string, subject_entity_id string")
    none = spark.createDataFrame([], "workstream_id string, kind string, raw string, entity_id string, canonical string, mention_count int, last_seen int, v array<double>, display_name string")
    out = entities.resolve_subjects(triples, none)
    got = {(r["workstream_id"], r["event_id"]): r["subject_entity_id"] for r in out["triples"].collect()}
    assert got["w", "e1"] == got["w", "e2"] != got["x", "e4"] and got["w", "e3"] == "had" and None not in got.values()
    assert {r["event_id"] for r in out["mentions"].collect()} == {"e1", "e4"} and out["entities"].count() == 2
    again = entities.resolve_subjects(spark.createDataFrame(out["triples"].collect(), out["triples"].schema), none)
    assert again["subjects"].count() == 0
    near = spark.createDataFrame([("w", "name", "Ann", "n-ann", "", 3, 1, [1.0, 0.0], "Ann")], none.schema)
    named = entities.resolve_subjects(triples, near, spark.createDataFrame([("w", "ann", [1.0, 0.01])], "workstream_id string, subject_key string, v array<double>"))
    assert {(r["entity_id"], r["tier"]) for r in named["subjects"].where("workstream_id = 'w'").collect()} == {("n-ann", 2)}


def test_fleet_run(spark, monkeypatch):
    """Only opted-in workstreams, shared and standing skills, eligible sources; a token of one workstream is refused; parts keep equal names together."""
    skills = spark.createDataFrame([("a", "s1", "pull", T0), ("b", "s2", "pull", T0), ("b", "s3", "push", T0), ("c", "s4", "pull", T0), ("a", "s5", "gone", T0), ("a", "s6", "private", T0), ("b", "s7", "secret", T0)], "workstream_id string, event_id string, name string, valid_at timestamp_ntz")
    log = spark.createDataFrame([(f"s{i}", 3 if i == 7 else 1) for i in range(1, 8)], "event_id string, classification int")
    config = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("global", True)], "workstream_id string, opted_in boolean")
    gone, seen = spark.createDataFrame([("s5", T0)], "event_id string, revoked_at timestamp_ntz"), spark.createDataFrame([("s6", 0)], "event_id string, visibility int")

    def dreamer(rows):
        out = [(f"o-{n}", 1, f"all {n}", sorted(g["event_id"]), 2) for n, g in rows.groupby("name")] + [(f"none-{rows['event_id'].min()}", 1, "unfounded", [], 2)]
        return pd.DataFrame(out, columns=["output_id", "category", "statement", "sources", "proposed"])

    kind = "output_id string, category int, statement string, sources array<string>, proposed int"
    with pytest.raises(gates.Denied):
        consolidate.fleet_run(gates.Token("u", "a", cross=True), config, skills, gone, seen, log, dreamer, kind, "2024-02-01 00:00:00")
    for part in (5000, 1):
        monkeypatch.setattr(consolidate, "FLEET_PART", part)
        out = consolidate.fleet_run(gates.Token("u", None, cross=True), config, skills, gone, seen, log, dreamer, kind, "2024-02-01 00:00:00")
        good, bad = ingest.validated(out["captures"])
        said = {r["payload"] for r in good.collect()}
        assert bad.count() == 0 and len(said) == 2 and any('"supportingEvents":["s1","s2"]' in p for p in said) and any("all push" in p for p in said)
        assert {(r["workstream_id"], r["principal_id"]) for r in good.collect()} == {("global", "u")} and {r["visibility"] for r in out["visibility"].collect()} == {2}
        s = out["summary"].first()
        assert (s["participating"], s["n_inputs"], s["n_outputs"]) == (2, 4, 2) and s["n_skipped"] >= 2


def talk(spark):
    turns = [("s1", 1, 0, "Ann", "I adopted a puppy named Rex in May"), ("s1", 1, 1, "Bob", "My garden grows tomatoes"), ("s1", 2, 0, "Ann", "Rex likes the garden"), ("s2", 1, 0, "Cy", "We moved to Oslo")]
    turns = spark.createDataFrame([(s, n, T0 + dt.timedelta(days=n), t, p, x) for s, n, t, p, x in turns], "sample_id string, session int, at timestamp, turn int, speaker string, text string")
    asked = [("s1", 0, "What puppy did Ann adopt?", "Rex", 1), ("s1", 1, "Which vegetables?", "tomatoes", 2), ("s1", 2, "Boom?", "x", 5), ("s2", 0, "Where did we move? Oslo?", "Oslo", 1), ("s2", 1, "puppy", "nobody knows", 5)]
    return turns, spark.createDataFrame(asked, "sample_id string, number int, question string, answer string, category int")


def hosts():
    def answerer(questions, contexts):
        if questions.str.contains("Boom").any():
            raise ValueError("the host fails")
        return pd.Series(["I do not know, not mentioned" if not c else c.split("\n")[0] for c in contexts])

    def judge(questions, gold, said):
        return pd.Series([g.lower() in s.lower() for g, s in zip(gold, said, strict=True)])

    return answerer, judge


def test_conversation_run(spark):
    (turns, questions), (answerer, judge) = talk(spark), hosts()
    graded, report = evaluation.conversation_run(turns, questions, answerer, judge, depth=2)
    got = {(r["sample_id"], r["number"]): r for r in graded.collect()}
    assert {k: r["correct"] for k, r in got.items()} == {("s1", 0): True, ("s1", 1): False, ("s1", 2): False, ("s2", 0): True, ("s2", 1): False}
    assert got["s1", 0]["predicted"].startswith("[2024-01-02] Ann: I adopted") and got["s1", 0]["gold_in_context"] and got["s1", 0]["tokens"] > 5
    assert got["s1", 2]["predicted"] == "[error]" and "not mentioned" in got["s1", 1]["predicted"] and got["s2", 1]["tokens"] == 0, "samples are stores of their own"
    parts = {r["part"]: (r["total"], r["right"]) for r in report.collect()}
    assert parts == {"1": (2, 2), "2": (1, 0), "5": (2, 0), "all": (5, 2), "all but 5": (3, 2)}
    planner = lambda q: (["garden tomatoes"], "") if "vegetables" in q else ([], "")
    again, report = evaluation.conversation_run(turns, questions, answerer, judge, depth=2, planner=planner, done=spark.createDataFrame([r for k, r in got.items() if k != ("s1", 1)], graded.schema))
    kept = {(r["sample_id"], r["number"]): r for r in again.collect()}
    assert len(kept) == 5 and kept["s1", 1]["correct"] and kept["s1", 0] == got["s1", 0] and report.where("part = 'all'").first()["right"] == 3


def test_kept_state(spark, sf_dir, tmp_path):
    kept = Kept(spark, str(tmp_path), 8)
    assert kept.mode("w") == "AutoDistill" and not kept.takes_part("w")
    kept.configure("w", "2024-01-01 00:00:00", mode="ReviewBeforeDistill")
    kept.configure("w", "2024-01-02 00:00:00", opted_in=True)
    kept.configure("v", "2024-01-02 00:00:00", opted_in=False)
    assert kept.mode("w") == "ReviewBeforeDistill" and [r[0] for r in maintenance.participants(kept.config.read()).collect()] == ["w"]
    with pytest.raises(ValueError):
        kept.configure("Not An Id", "2024-01-02 00:00:00")

    people = spark.createDataFrame([("n1", "w", "name", "Ann"), ("n1", "w", "name", "Anna"), ("n2", "w", "name", "Bob")], "entity_id string, workstream_id string, kind string, display_name string")
    seen = spark.createDataFrame([("n1", "e1", T0), ("n1", "e2", T0 + dt.timedelta(days=2))], "entity_id string, event_id string, seen_at timestamp_ntz")
    for _ in range(2):
        kept.mentioned(people, seen)
    kept.mentioned(people.limit(0), seen.withColumn("event_id", F.lit("e3")).limit(1))
    got = {r["entity_id"]: (r["mention_count"], r["last_seen"]) for r in kept.entities.read().collect()}
    assert got == {"n1": (3, T0 + dt.timedelta(days=2)), "n2": (0, None)}

    log, cur = A.log(spark, sf_dir), A.curations(spark, sf_dir)
    events = bundle.scored_events(log, A.revocations(spark, sf_dir), cur, A.NOW)
    first = kept.served(["ws-1", "ws-2"], events, log, cur, "2100-01-01 00:00:00")
    assert {r["workstream_id"]: r["generated_at"].day for r in first.collect()} == {"ws-1": 1, "ws-2": 1}
    again = kept.served(["ws-1", "ws-3"], events, log, cur, "2100-01-02 00:00:00")
    assert {r["workstream_id"]: r["generated_at"].day for r in again.collect()} == {"ws-1": 1, "ws-3": 2} and kept.bundles.read().count() == 3
    assert kept.served(["ws-1"], events, log, cur, "2100-01-03 00:00:00", refresh=True).first()["generated_at"].day == 3

    from eventloom.operators import sessions

    entries = spark.createDataFrame([("s", f"{i:03d}", T0, 0, x) for i, x in enumerate(["we will go with plan B now", "the sky over Paris was grey"])], "session_id string, entry_id string, entry_at timestamp_ntz, kind int, text string")
    home = spark.createDataFrame([("s", "w", "u")], "session_id string, workstream_id string, principal_id string")
    for n in (2, 0):
        out = sessions.distil_run(entries, kept.watermarks.read().select("session_id", "last_entry"), kept.runs.read().drop("n_events"), home, "2024-02-01 00:00:00")
        assert out["captures"].count() == n
        kept.session_run(out)
    assert kept.watermarks.of_keys(["s"]).first()["last_entry"] == "001" and kept.runs.read().count() == 1


def test_small_sources(spark, tmp_path):
    """S8, S15, S21, K26, T12, U5, R28, R33, X2, X10."""
    vectors = spark.createDataFrame([("e", "p", [1.0])], "event_id string, provider_id string, embedding array<double>")
    assert maintenance.has_embeddings(vectors, "p") and not maintenance.has_embeddings(vectors, "q")
    (tmp_path / "f.json").write_text('{"name": "n", "workstream": "w", "turns": [{"speaker": "A", "at": "2024-01-01", "content": "c", "shouldCapture": true, "category": "fact"}], "probes": [{"question": "q", "expectedSubstring": "x"}]}')
    fixture = files.bench_fixture(spark, str(tmp_path / "f.json")).first()
    assert fixture["turns"][0]["shouldCapture"] and fixture["probes"][0]["asOf"] is None
    (tmp_path / "t.jsonl").write_text('{"sample_id": "s", "subject": "Ann\'s  Team", "predicate": "p", "object": "o"}\n{"torn')
    assert [r["subject_key"] for r in files.sidecar_triples(spark, str(tmp_path / "t.jsonl")).collect()] == ["ann team"]
    hits = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 2.0), ("c", 3.0)], "event_id string, score double")
    assert [r["event_id"] for r in evaluation.best_of(hits, 3).collect()] == ["b", "c", "a"]
    extra = maintenance.with_extras(hits.where("event_id = 'b'"), spark.createDataFrame([("b",), ("z",), ("z",)], "event_id string"))
    assert sorted((r["event_id"], r["score"]) for r in extra.collect()) == [("b", 3.0), ("z", None)]
    assert [one(spark, text.abstains(F.lit(x))) for x in ("", "[error] x", f"It is {text.ABSTAIN[0]} anywhere", "Oslo")] == [True, True, True, False]
    files.write_report(spark.createDataFrame([('say "hi", then\nleave', 1)], "x string, y int").coalesce(1), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv")).first()["x"] == 'say "hi", then\nleave'
    judged = consolidate.judged(hits, lambda b: b.assign(ok=b["score"] > 1)[["event_id", "ok"]], "event_id string, ok boolean")
    assert judged.where("ok").count() == 3
    stamped = entities.stamped(spark.createDataFrame([("w", "k", None), ("w", "k", "old"), ("w", "l", None)], "workstream_id string, subject_key string, subject_entity_id string"), spark.createDataFrame([("w", "k", "new")], "workstream_id string, subject_key string, entity_id string"))
    assert sorted(str(r["subject_entity_id"]) for r in stamped.collect()) == ["None", "new", "old"]


def test_bundle_distiller_seam(spark, sf_dir):
    """A host's distiller makes the bundles that are due, and they are served from the cache afterwards."""
    log, cur = A.log(spark, sf_dir), A.curations(spark, sf_dir)
    events = bundle.scored_events(log, A.revocations(spark, sf_dir), cur, A.NOW)

    def host(due):
        last = scans.latest(log).select("workstream_id", F.col("event_id").alias("covered_through"))
        none = bundle.BUNDLE.split("sections ")[1].split(", hints")[0], bundle.BUNDLE.split("hints ")[1].split(", token_count")[0]
        out = due.groupBy("workstream_id").agg(F.concat(F.lit("about "), F.count("*").cast("string")).alias("orientation")).join(last, "workstream_id")
        return out.withColumn("sections", F.array().cast(none[0])).withColumn("hints", F.array().cast(none[1])).withColumn("token_count", F.lit(3).cast("long")).withColumn("generated_at", F.lit("2100-01-01").cast("timestamp_ntz"))

    out, cache = bundle.served(spark.createDataFrame([], bundle.BUNDLE), events, log, cur, A.NOW, distiller=host, distiller_id="mine")
    cache = spark.createDataFrame(cache.collect(), cache.schema)
    assert {r["distiller"] for r in out.collect()} == {"mine"} and all(r["orientation"].startswith("about ") for r in cache.collect())
    assert {r["distiller"] for r in bundle.served(cache, events, log, cur, A.NOW)[0].collect()} == {"mine"}
