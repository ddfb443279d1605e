"""Steps whose work must not grow faster than their input, and what they give on odd rows."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from eventloom import adapter as A
from eventloom.operators import consolidate, maintenance, projections, textindex
from eventloom.sources.versioned import Versioned

TRIPLE = "workstream_id string, event_id string, ordinal int, subject_key string, predicate string, object string, valid_at long"


def odd_triples(spark):
    """Several triples a fact, objects that differ only in case, nulls, a redelivered fact."""
    rows = [("w", "e1", 0, "s", "p", "Red", 1), ("w", "e1", 1, "s", "p", "blue", 1), ("w", "e2", 0, "s", "p", " red", 2), ("w", "e3", 0, "s", "p", "red", 3), ("w", "e3", 2, "s", "p", "RED ", 3), ("w", "e4", 3, "s", "p", "blue", 0), ("w", "e5", 0, "s", "p", "blue", 7), ("w", "e5", 1, "s", "p", "green", 7)]
    rows += [rows[2], ("v", "e6", 0, "s", "p", "blue", 1), (None, "e7", 0, "s", "p", "blue", 1), (None, "e8", 0, "s", "p", "red", 1), ("w", "e9", 0, "s", "p", None, 1), ("w", "f1", 0, "s", "q", "x", 1), ("w", "f2", 0, "s", "q", "y", None)]
    return spark.createDataFrame(rows, TRIPLE)


def pairs_of(rows, others=None):
    """J8 by brute force."""
    best = {}
    for x, y in itertools.product(rows, rows) if others is None else [*itertools.product(rows, others), *itertools.product(others, rows)]:
        if None not in (x[0], x[5], y[5]) and x[0] == y[0] and x[3:5] == y[3:5] and x[1] < y[1] and x[5].strip(" ").lower() != y[5].strip(" ").lower():
            key, found = (x[0], x[3], x[4], x[1], y[1]), (x[2], y[2], x[5], y[5], max(t for t in (x[6], y[6]) if t is not None))
            best[key] = min(best.get(key, found), found)
    return sorted((*k, *v[2:]) for k, v in best.items())


def test_contradictions_of_odd_triples(spark):
    triples = odd_triples(spark)
    got = sorted(tuple(r) for r in projections.contradictions(triples).collect())
    assert got == pairs_of([tuple(r) for r in triples.collect()]) and len(got) == 10
    new, old = triples.where("event_id in ('e1', 'e4', 'f1')"), triples.where("event_id not in ('e1', 'e4', 'f1')")
    got = sorted(tuple(r) for r in projections.contradictions(new, old).collect())
    assert got == pairs_of([tuple(r) for r in new.collect()], [tuple(r) for r in old.collect()]) and got


def test_pairs_leave_the_join_as_they_are(spark):
    """Nothing above the join sorts, groups or shuffles what grows with the square of a subject's facts."""
    triples = odd_triples(spark)
    plan = projections.contradictions(triples)._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and "Exchange" not in above and "Sort" not in above.replace("SortMerge", "")


def test_unseen_facts_go_before_pairs_are_made(spark, sf_dir):
    from eventloom.plans.queries import QUERIES

    triples = odd_triples(spark)
    log = triples.selectExpr("event_id", "case when event_id = 'e1' then 'u' else 'other' end as principal_id").distinct()
    hidden = spark.createDataFrame([("e1", 0), ("e2", 0), ("e4", 1)], "event_id string, visibility int")
    seen, kept = consolidate.contradictions_seen(triples, log, hidden, "u"), consolidate.visible_contradictions(projections.contradictions(triples), log, hidden, "u")
    assert sorted(map(tuple, seen.select(kept.columns).collect())) == sorted(map(tuple, kept.collect())) and 0 < kept.count() < 10
    plan = QUERIES["visible_contradictions"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan[: plan.index("Join Inner")]


def test_pairs_are_counted_without_pairs(spark, sf_dir):
    triples = odd_triples(spark)
    for some in (triples, triples.where("event_id > 'e2'"), triples.limit(0)):
        assert projections.contradiction_count(some).first()["n"] == projections.contradictions(some).count()
    keys = [("w", "k", "e1", 1), ("w", "k", "e2", 1), ("w", "k", "e2", 1), ("w", "k", "e2", 2), ("w", "k", "e3", None), ("w", None, "e4", 1), ("w", None, "e5", 2), (None, "k", "e6", 1), (None, "k", "e7", 2), ("v", "k", "e8", 1), ("v", "k", "e9", 0)]
    rows = spark.createDataFrame([(*k, 0) for k in keys], "workstream_id string, key string, event_id string, created_at long, valid_at long")
    assert projections.duplicate_count(rows).first()["n"] == projections.duplicate_pairs(rows).count() == 6
    assert projections.duplicate_count(rows.limit(0)).first()["n"] == 0
    plan = maintenance.rebuild_counts(A.log(spark, sf_dir), A.revocations(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan


def test_the_index_moves_rows_once_a_table(spark, tmp_path):
    """Documents, postings and cells each shuffle once; what is kept is what a plain count gives, over batches and a rerun."""
    text = "event_id string, workstream_id string, created_at timestamp_ntz, content string"
    long = " ".join(f"w{k % 1700}" for k in range(20_000))
    rows = [("a", "w", dt.datetime(2024, 1, 1), "Éa ea, EA b-b_b b́ 42"), ("b", None, None, long), ("c", "w", None, ""), ("d", "w", None, None), ("e", "v", None, " -- !? "), ("f", "v", dt.datetime(2024, 1, 2), "日本語 x²  ⅷ one")]
    corpus = spark.createDataFrame(rows, text)
    store, moved, written = textindex.IndexStore(spark, str(tmp_path / "i"), buckets=3), [], Versioned._written

    def spy(self, rows, unpack=None):
        moved.append(rows._jdf.queryExecution().sparkPlan().toString().count("Aggregate"))
        return written(self, rows, unpack)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(Versioned, "_written", spy)
        store.add(corpus.where("event_id < 'c'"), 0)
        assert moved[:3] == [0, 0, 0]
        store.add(corpus.where("event_id >= 'c'"), 1)
        store.add(corpus.where("event_id >= 'c'"), 1)
    plain = textindex.indexed(corpus)
    order = lambda d, *c: sorted(map(repr, d.select(*c).collect()))
    columns = ("event_id", "term", "workstream_id", "created_at", "dl", "tf", "cell")
    assert order(store.postings.read(), *columns) == order(plain.postings, *columns)
    each = lambda d: d.selectExpr("event_id", "workstream_id", "created_at", "dl", "array_sort(map_entries(counts)) as counts")
    assert order(each(store.documents.read()), "*") == order(each(plain.documents), "*")
    cells = store.cells.read().groupBy("term", "workstream_id", "cell").agg(F.sum("n").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
    assert order(cells, "*") == order(plain.cells, "*")
    total = [d.agg(F.sum("n"), F.sum("words")).first() for d in (store.sizes.read(), plain.sizes)]
    assert total[0] == total[1] and total[0][0] == 6
