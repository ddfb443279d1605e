"""Subjects by pieces and vectors by clusters against plain scans, and how little they read."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_index import records_read

from eventloom.operators import search, subjects


def triple_rows(spark, keys):
    rows = [("w", f"e{i}", 0, k, "p", "o", None) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, subjects.TRIPLE)


def test_matches_like_a_scan(spark, tmp_path):
    keys = ["user1", "user12", "user 1's team", "user1 team", "u", "us", "ab", "", "ÄÖ", "bob", "bobby", "team", "a user12 b"] * 2
    index, triples = subjects.SubjectIndex(spark, str(tmp_path / "s"), 7), triple_rows(spark, keys)
    for part in (0, 1):
        for _ in range(2):
            index.add(triples.where(F.expr(f"cast(substring(event_id, 2) as int) % 2 = {part}")), part)
    for wanted in (["user1"], ["us"], ["user12's team", "bob"], ["äö", "ÄÖ"], ["nothing"], [""], ["bobbyuser1"], []):
        want = sorted(r["event_id"] for r in search.subject_match(triples, wanted).collect())
        assert sorted(r["event_id"] for r in index.match(wanted).collect()) == want, wanted


def test_reads_in_proportion_to_hits(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    names = ["".join(rng.choice(list("bcdfghjklmnp"), 9)) for _ in range(4000)]
    triples = triple_rows(spark, [n for n in names for _ in range(5)] + ["the zebra crossing"] * 3)
    index = subjects.SubjectIndex(spark, str(tmp_path / "s"), 64)
    index.add(triples)
    before = records_read(spark)
    assert index.match(["zebra"]).count() == 3 and records_read(spark) - before < 0.15 * (20_003 + index.grams.read().count())
    monkeypatch.setattr(subjects, "MOST_KEYS", 0)
    assert index.match(["zebra"]).count() == 3


@pytest.mark.parametrize("clustered", [True, False])
def test_vectors_exactly(spark, tmp_path, clustered):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(20, 8))
    points = [(middles[i % 20] + 0.02 * rng.normal(size=8) if clustered else rng.normal(size=8)) for i in range(2000)] + [np.zeros(8), middles[0], middles[0]]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    index = subjects.VectorIndex(df, "vec_id", 40, str(tmp_path / "v"))
    for q in (middles[0], middles[3], rng.normal(size=8)):
        query = spark.createDataFrame([([float(x) for x in q],)], "q array<double>")
        want = [(r["vec_id"], r["cosine"]) for r in search.vector_topk(df, query, 15).collect()]
        got = index.topk(list(q), 15)
        assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-12) and {i for i, _ in got[:5]} == {i for i, _ in want[:5]}
        assert not clustered or index.scored < 1000
    assert index.topk([0.0] * 8, 3) == [(0, 0.0), (1, 0.0), (2, 0.0)]
