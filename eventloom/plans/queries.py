"""Every registered query of the engine, with its DuckDB twin."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapter as A
from ..functions import scoring as R
from ..functions import text as X
from ..functions.redaction import redact
from ..functions import payloads as P
from ..operators import bundle, consolidate, curation, dispatch, entities, evaluation, gates, maintenance, projections, scans, search, sessions, sync, textindex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CLOCK = dt.datetime(2024, 2, 1)
#: Tokens of the gate tests.
TOK1 = gates.Token("user-8", "ws-1")
TOK2 = gates.Token("user-46", None, cross=True)
TOK3 = gates.Token("user-8", "ws-1", categories=(1, 2), technical=True)
#: Three words of middling frequency.
SEARCH = "thtion ering onble"
QUESTION = "What did User3 and User12's team do?"
GATE = "(coalesce(visibility, 1) >= 1 OR coalesce(principal_id = '{v}', FALSE))"
SUMMARY = "CASE WHEN length(t) <= 200 THEN t ELSE substring(t, 1, 200) || '…' END"
TEXT = "CASE WHEN skill_name IS NOT NULL THEN 'Skill: ' || skill_name ELSE statement END"
ITEM = f"event_id, workstream_id, category, principal_id, valid_at, created_at, {SUMMARY} AS summary"


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return A.log(spark, d), A.revocations(spark, d), A.visibility(spark, d)


# ---- scans and gates ---------------------------------------------------------------------------


def scan_sql(where: str, limit: int, order: str = "valid_at", viewer: str = "user-8") -> str:
    return f"""{A.ctes('log', 'rev', 'vis')},
    k AS (SELECT *, {TEXT} AS t FROM log LEFT JOIN vis USING (event_id) WHERE event_channel = 0 AND {where} AND {GATE.format(v=viewer)} ORDER BY {order} DESC, event_id LIMIT {limit})
    SELECT {ITEM} FROM k WHERE event_id NOT IN (SELECT event_id FROM rev)"""


@query(scan_sql("workstream_id = 'ws-1'", 50))
def structured_scan(spark, d):
    return scans.structured_scan(*sides(spark, d), gates.enforce(TOK1, CLOCK), limit=50)


@query(scan_sql("workstream_id = 'ws-1' AND valid_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'", 100))
def structured_scan_range(spark, d):
    return scans.structured_scan(*sides(spark, d), gates.enforce(TOK1, CLOCK), 100, "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query(scan_sql("workstream_id = 'ws-1' AND created_at <= TIMESTAMP '2024-01-20' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-20')", 500))
def structured_scan_asof(spark, d):
    return scans.structured_scan(*sides(spark, d), gates.enforce(TOK1, CLOCK), 500, as_of="2024-01-20 00:00:00")


@query(scan_sql("workstream_id = 'ws-1' AND principal_id = 'user-8'", 25))
def structured_scan_principal(spark, d):
    return scans.structured_scan(*sides(spark, d), gates.enforce(TOK1, CLOCK), 25, principal="user-8")


@query(scan_sql("workstream_id = 'ws-1' AND category IN (1, 2)", 100).replace("event_channel = 0", "event_channel = 1"))
def technical_scan(spark, d):
    return scans.structured_scan(*sides(spark, d), gates.enforce(TOK3, CLOCK, channel=1), 100)


@query(scan_sql("TRUE", 100, viewer="user-46"))
def cross_workstream_scan(spark, d):
    return scans.structured_scan(*sides(spark, d), gates.enforce(TOK2, CLOCK), 100)


@query(scan_sql("workstream_id = 'ws-1'", 50, "created_at"))
def list_recent(spark, d):
    return scans.list_recent(*sides(spark, d), gates.enforce(TOK1, CLOCK), 50)


@query(f"{A.ctes('log')} SELECT workstream_id, max(struct_pack(a := created_at, b := event_id)).b AS event_id, max(created_at) AS created_at FROM log GROUP BY workstream_id")
def latest_event(spark, d):
    return scans.latest(A.log(spark, d))


@query(f"{A.ctes('log', 'rev')} SELECT event_id, category, created_at, revoked_at FROM log LEFT JOIN rev USING (event_id) WHERE category = 2")
def log_scan(spark, d):
    return scans.read_all(A.log(spark, d), A.revocations(spark, d), 2).select("event_id", "category", "created_at", "revoked_at")


@query(f"{A.ctes('log')} SELECT event_id, workstream_id, category, statement FROM log WHERE event_id = 'ev-000000042'")
def point_lookup(spark, d):
    return scans.read_one(A.log(spark, d), "ev-000000042").select("event_id", "workstream_id", "category", "statement")


@query(f"{A.ctes('log', 'vis')} SELECT event_id, principal_id, visibility FROM log LEFT JOIN vis USING (event_id) WHERE {GATE.format(v='user-8')}")
def visibility_gate(spark, d):
    log, _, vis = sides(spark, d)
    return gates.with_visibility(log, vis).where(gates.visible("user-8")).select("event_id", "principal_id", "visibility")


@query(f"{A.ctes('log', 'rev')} SELECT event_id, workstream_id FROM log WHERE event_id NOT IN (SELECT event_id FROM rev)")
def revocation_anti(spark, d):
    log, rev, _ = sides(spark, d)
    return gates.not_revoked(log, rev).select("event_id", "workstream_id")


@query(f"{A.ctes('log', 'rev', 'vis', 'cur')} SELECT event_id, statement, classification, revoked_at, visibility FROM log LEFT JOIN rev USING (event_id) LEFT JOIN vis USING (event_id) WHERE event_id IN (SELECT target_id FROM cur)")
def hydrate_semi(spark, d):
    log, rev, vis = sides(spark, d)
    candidates = A.curations(spark, d).select(F.col("target_id").alias("event_id"))
    return gates.hydrate(log, rev, vis, candidates).select("event_id", "statement", "classification", "revoked_at", "visibility")


# ---- aggregates --------------------------------------------------------------------------------


@query(f"{A.ctes('log', 'rev')} SELECT count(*) AS events, count(revoked_at) AS revoked, count(*) FILTER (WHERE category = 1) AS facts, count(*) FILTER (WHERE category = 2) AS decisions, count(*) FILTER (WHERE category = 4) AS goals, count(*) FILTER (WHERE category = 3) AS hypotheses, count(DISTINCT workstream_id) AS workstreams FROM log LEFT JOIN rev USING (event_id)")
def metrics_counts(spark, d):
    return evaluation.counts(A.log(spark, d), A.revocations(spark, d))


@query(f"{A.ctes('log')} SELECT category, count(*) AS n FROM log GROUP BY category")
def by_category(spark, d):
    return evaluation.grouped(A.log(spark, d), "category")


@query(f"{A.ctes('log')} SELECT classification, count(*) AS n FROM log GROUP BY classification")
def by_classification(spark, d):
    return evaluation.grouped(A.log(spark, d), "classification")


@query(f"{A.ctes('log')} SELECT DISTINCT workstream_id FROM log ORDER BY 1")
def distinct_workstreams(spark, d):
    return A.log(spark, d).select("workstream_id").distinct().orderBy("workstream_id")


# ---- projections -------------------------------------------------------------------------------


@query(f"{A.ctes('log', 'rev')} SELECT workstream_id, event_id, statement, '[\"' || supporting[1] || '\"]' AS supporting, valid_at, revoked_at FROM log LEFT JOIN rev USING (event_id) WHERE category = 1")
def project_facts(spark, d):
    return projections.facts(A.log(spark, d), A.revocations(spark, d))


for _name, _category in (("decisions", 2), ("hypotheses", 3), ("goals", 4)):
    query(f"{A.ctes('log', 'rev')} SELECT workstream_id, event_id, statement, principal_id, valid_at, revoked_at FROM log LEFT JOIN rev USING (event_id) WHERE category = {_category}", f"project_{_name}")(
        lambda spark, d, c=_category: projections.statements(A.log(spark, d), A.revocations(spark, d), c)
    )


@query(f"{A.ctes('log', 'rev')} SELECT workstream_id, event_id, skill_name AS name, statement AS procedure, valid_at, revoked_at FROM log LEFT JOIN rev USING (event_id) WHERE category = 0 AND skill_name IS NOT NULL")
def project_skills(spark, d):
    return projections.skills(A.log(spark, d), A.revocations(spark, d))


TRIPLES = "tri AS (SELECT workstream_id, event_id, CAST(0 AS INT) AS ordinal, trim(replace(lower(subject), '''s team', ' team')) AS subject_key, predicate, object, valid_at FROM log WHERE category = 1)"


@query(f"{A.ctes('log')}, {TRIPLES} SELECT * FROM tri")
def project_triples(spark, d):
    return projections.triples(A.log(spark, d))


@query(
    f"""{A.ctes('log')}, {TRIPLES} SELECT a.workstream_id, a.subject_key, a.predicate, a.event_id AS event_a, b.event_id AS event_b, a.object AS object_a, b.object AS object_b, greatest(a.valid_at, b.valid_at) AS detected_at
    FROM tri a JOIN tri b ON a.workstream_id = b.workstream_id AND a.subject_key = b.subject_key AND a.predicate = b.predicate AND a.event_id < b.event_id AND lower(trim(a.object)) <> lower(trim(b.object))"""
)
def contradictions(spark, d):
    return projections.contradictions(projections.triples(A.log(spark, d)))


@query(
    f"""{A.ctes('log')}, f AS (SELECT *, lower(trim(statement)) AS k FROM log WHERE category = 1)
    SELECT a.workstream_id, a.event_id AS canonical_event, b.event_id AS duplicate_event, greatest(a.valid_at, b.valid_at) AS detected_at
    FROM f a JOIN f b ON a.workstream_id = b.workstream_id AND a.k = b.k AND (a.created_at < b.created_at OR (a.created_at = b.created_at AND a.event_id < b.event_id))"""
)
def duplicates(spark, d):
    return projections.duplicates(A.log(spark, d))


_HALF = "cast(substring(event_id, 4) as bigint) % 3 = 0"


@query(ORACLES["contradictions"])
def contradictions_delta(spark, d):
    """The same pairs from a part of the log and what came later: old with old, new with new, new with old."""
    triples = projections.triples(A.log(spark, d))
    new, old = triples.where(_HALF), triples.where(f"not ({_HALF})")
    return projections.contradictions(old).unionByName(projections.contradictions(new)).unionByName(projections.contradictions(new, old))


@query(ORACLES["duplicates"])
def duplicates_delta(spark, d):
    facts = projections.fact_keys(A.log(spark, d))
    new, old = facts.where(_HALF), facts.where(f"not ({_HALF})")
    return projections.duplicate_pairs(old).unionByName(projections.duplicate_pairs(new)).unionByName(projections.duplicate_pairs(new, old))


@query(
    f"""{A.ctes('log')}, {TRIPLES}, v AS (SELECT workstream_id, subject_key, predicate, lower(trim(object)) AS value, count(DISTINCT event_id) AS facts, min(event_id) AS first_event FROM tri GROUP BY ALL),
    n AS (SELECT *, count(*) OVER w AS n_values, CAST(sum(facts) OVER w AS BIGINT) - facts AS others FROM v WINDOW w AS (PARTITION BY workstream_id, subject_key, predicate)) SELECT * FROM n WHERE n_values > 1"""
)
def contradiction_classes(spark, d):
    return projections.contradiction_classes(projections.triples(A.log(spark, d)))


@query(
    f"""{A.ctes('log')},
    a AS (SELECT workstream_id, decision_ref AS decision_id, max(struct_pack(c := created_at, i := event_id)).i AS action_id, min(struct_pack(c := created_at, i := event_id, v := valid_at)).v AS acted FROM log WHERE category = 5 GROUP BY 1, 2),
    o AS (SELECT action_ref AS action_id, max(struct_pack(c := created_at, i := event_id, p := polarity)) AS o FROM log WHERE category = 6 GROUP BY 1),
    n AS (SELECT workstream_id, event_id AS decision_id, valid_at FROM log WHERE category = 2)
    SELECT workstream_id, decision_id, coalesce(n.valid_at, a.acted) AS decision_at, action_id, o.i AS outcome_id, o.p AS polarity, o.i IS NOT NULL AS closed
    FROM n FULL JOIN a USING (workstream_id, decision_id) LEFT JOIN o USING (action_id)"""
)
def decision_chains(spark, d):
    return projections.decision_chains(A.log(spark, d))


@query(
    f"""{A.ctes('log')},
    w AS (SELECT o.created_at AS done, o.event_id AS oid, 0.1 * ((o.polarity + 1) / 2.0 - 0.5) AS delta, n.event_id AS d, n.supporting AS s
          FROM log o JOIN log a ON o.action_ref = a.event_id AND a.category = 5 JOIN log n ON a.decision_ref = n.event_id AND n.category = 2 WHERE o.category = 6),
    t AS (SELECT done, oid, delta, unnest(list_distinct(list_concat([d], coalesce(s, [])))) AS event_id FROM w)
    SELECT event_id, round(list_reduce(list_prepend(CAST(1.0 AS DOUBLE), list(CAST(delta AS DOUBLE) ORDER BY done, oid)), lambda x, y: least(5.0, greatest(0.1, x + y))), 6) AS weight, count(*) AS updates FROM t GROUP BY event_id"""
)
def feedback_weights(spark, d):
    return projections.feedback_weights(A.log(spark, d))


# ---- curation and review -----------------------------------------------------------------------


@query(f"{A.ctes('cur')} SELECT target_id, x.c AS curation_id, x.k AS kind, x.o AS occurred_at FROM (SELECT target_id, max(struct_pack(o := occurred_at, c := curation_id, k := kind)) AS x FROM cur WHERE NOT reverted GROUP BY target_id)")
def latest_curation(spark, d):
    return curation.latest_curation(A.curations(spark, d))


@query(f"{A.ctes('cur')} SELECT target_id, count(*) FILTER (WHERE kind = 1 AND NOT reverted) AS annotations FROM cur GROUP BY target_id")
def annotation_count(spark, d):
    return curation.annotation_count(A.curations(spark, d))


MULT = "mul AS (SELECT target_id, max(struct_pack(o := occurred_at, c := curation_id, m := multiplier)).m AS multiplier FROM cur WHERE NOT reverted AND kind IN (2, 3) GROUP BY target_id)"
AMEND = "ame AS (SELECT target_id, max(struct_pack(o := occurred_at, c := curation_id, n := new_content)).n AS amended FROM cur WHERE NOT reverted AND kind = 0 GROUP BY target_id)"


@query(f"{A.ctes('cur')}, {MULT} SELECT DISTINCT target_id, coalesce(mul.multiplier, 1.0) AS multiplier FROM cur LEFT JOIN mul USING (target_id)")
def effective_multiplier(spark, d):
    cur = A.curations(spark, d)
    return cur.select("target_id").distinct().join(curation.latest_multiplier(cur), F.col("target_id") == F.col("multiplier_target"), "left").select("target_id", F.coalesce("latest_multiplier", F.lit(1.0)).alias("multiplier"))


@query(
    f"""{A.ctes('log', 'cur')}, {MULT}, {AMEND}, ann AS (SELECT target_id, count(*) FILTER (WHERE kind = 1 AND NOT reverted) AS n FROM cur GROUP BY target_id)
    SELECT target_id, upper(sha256('v1|content=' || coalesce(amended, statement) || '|mult=' || CASE WHEN coalesce(multiplier, 1.0) = floor(coalesce(multiplier, 1.0)) THEN CAST(CAST(coalesce(multiplier, 1.0) AS BIGINT) AS VARCHAR) ELSE CAST(multiplier AS VARCHAR) END || '|ann=' || n)) AS hash
    FROM ann JOIN log ON event_id = target_id LEFT JOIN mul USING (target_id) LEFT JOIN ame USING (target_id)"""
)
def pre_state_hash(spark, d):
    return curation.target_state(A.log(spark, d), A.curations(spark, d))


@query(f"{A.ctes('log', 'cur')} SELECT curation_id, target_id, workstream_id, kind, occurred_at, curator FROM cur JOIN log ON target_id = event_id WHERE workstream_id = 'ws-0' AND occurred_at >= TIMESTAMP '2024-01-10'")
def curation_history(spark, d):
    out = curation.history(A.curations(spark, d), A.log(spark, d), "ws-0", "2024-01-10 00:00:00")
    return out.select("curation_id", "target_id", "workstream_id", "kind", "occurred_at", "curator")


@query(f"{A.ctes('log', 'review')} SELECT event_id, workstream_id, status, captured_at, defer_until, summary FROM review WHERE status = 'pending' OR (status = 'deferred' AND defer_until <= TIMESTAMP '{A.REVIEW_NOW}')")
def review_pending(spark, d):
    return curation.review_pending(A.reviews(spark, d), A.REVIEW_NOW)


# ---- retrieval ---------------------------------------------------------------------------------

_TERMS = X.query_terms(SEARCH)
_TF = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(_TERMS))
_DF = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(_TERMS)))
_SCORE = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(_TERMS)))
BM25 = f"""tok AS (SELECT *, list_filter(string_split_regex(strip_accents(lower(coalesce(content, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM corpus),
    tf AS (SELECT doc_id, event_id, workstream_id, created_at, len(t) AS dl, {_TF} FROM tok),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {_DF} FROM tf),
    bm AS (SELECT doc_id, event_id, workstream_id, created_at, -({_SCORE}) AS raw FROM tf, st WHERE greatest(f0, f1, f2) > 0)"""
_K, _X0 = R.regime(len(_TERMS))
REC = f"exp(-(epoch_us(TIMESTAMP '{A.NOW}') - epoch_us(created_at)) / 86400000000.0 / 30)"


@query(f"{A.ctes('corpus')}, {BM25} SELECT event_id, round(raw, 6) AS raw_score FROM bm ORDER BY raw, event_id LIMIT 100")
def bm25_topk(spark, d):
    return textindex.bm25(A.text_index(spark, d), SEARCH).orderBy("raw_score", "event_id").limit(100).select("event_id", F.round("raw_score", 6).alias("raw_score"))


#: The gates of free-text search in SQL, for one viewer and workstream.
PASS = f"{GATE.format(v='user-8')} AND workstream_id = 'ws-1' AND event_channel = 0 AND event_id NOT IN (SELECT event_id FROM crev)"
LEXICAL = f"""{A.ctes('corpus', 'clog', 'crev', 'cvis')}, {BM25}, k AS (SELECT doc_id, event_id, raw, 1 / (1 + exp(-((-raw) - ({_X0})) / {_K})) AS bm25, {REC} AS recency FROM bm WHERE workstream_id = 'ws-1' ORDER BY raw, event_id LIMIT 100),
    g AS (SELECT k.event_id, raw, bm25, recency, category, valid_at, created_at, invalid_at, principal_id FROM k JOIN clog USING (event_id) LEFT JOIN cvis USING (event_id) WHERE {PASS})"""
_LEX = "event_id, round(raw, 6) AS raw_score, round(bm25, 6) AS bm25, round(recency, 6) AS recency, round(bm25 * recency, 6) AS score"


def _lexical(spark, d, token=TOK1, bounds=search.Bounds()):
    out = search.lexical_search(A.text_index(spark, d), A.corpus_events(spark, d), gates.enforce(token, CLOCK), SEARCH, A.NOW, 100, bounds)
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in ("raw_score", "bm25", "recency", "score")))


@query(f"{LEXICAL} SELECT {_LEX} FROM g")
def lexical_search(spark, d):
    return _lexical(spark, d)


@query(f"{LEXICAL} SELECT {_LEX} FROM g WHERE category IN (1, 2) AND created_at <= TIMESTAMP '2024-01-20' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-20') AND valid_at >= TIMESTAMP '2024-01-03'")
def lexical_gated(spark, d):
    token = gates.Token("user-8", "ws-1", categories=(1, 2))
    return _lexical(spark, d, token, search.Bounds(since="2024-01-03 00:00:00", as_of="2024-01-20 00:00:00"))


@query(f"{LEXICAL} SELECT {_LEX} FROM g WHERE principal_id = 'user-11'")
def lexical_principal(spark, d):
    return _lexical(spark, d, bounds=search.Bounds(principal="user-11"))


def _regime_sql(i: int) -> str:
    return "CASE " + " ".join(f"WHEN n <= {int(r[0])} THEN {r[i]}" for r in R.REGIMES[:-1]) + f" ELSE {R.REGIMES[-1][i]} END"


@query(f"SELECT doc_id, n, slope, centre, round(1 / (1 + exp(-(raw - centre) / slope)), 6) AS score FROM (SELECT doc_id, CAST(doc_id % 20 AS INT) AS n, CAST(doc_id % 40 AS DOUBLE) AS raw, CAST({_regime_sql(1).replace('n <=', 'doc_id % 20 <=')} AS DOUBLE) AS slope, CAST({_regime_sql(2).replace('n <=', 'doc_id % 20 <=')} AS DOUBLE) AS centre FROM documents)")
def adaptive_sigmoid(spark, d):
    rows = A.read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 20).cast("int").alias("n"), (-(F.col("doc_id") % 40)).cast("double").alias("raw"))
    slope, centre = R.regime_columns(F.col("n"))
    rows = rows.withColumn("slope", slope).withColumn("centre", centre)
    return rows.select("doc_id", "n", "slope", "centre", F.round(R.sigmoid(F.col("raw"), F.col("slope"), F.col("centre")), 6).alias("score"))


def _query_vector(spark, d):
    return A.vectors(spark, d).where("vec_id = 0").select(F.col("embedding").alias("q"))


COS = "least(1.0, greatest(0.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))))"


@query(f"SELECT vec_id, round({COS}, 6) AS cosine FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 25")
def vector_topk(spark, d):
    return search.vector_topk(A.vectors(spark, d), _query_vector(spark, d), 25).select("vec_id", F.round("cosine", 6).alias("cosine"))


HYBRID = f"""{A.ctes('corpus', 'clog', 'crev', 'cvis')}, {BM25},
    sem AS (SELECT event_id, {COS} AS semantic FROM (SELECT 'doc-' || vec_id AS event_id, embedding FROM embeddings) JOIN clog USING (event_id) WHERE workstream_id = 'ws-1' AND event_id NOT IN (SELECT event_id FROM crev) ORDER BY 2 DESC, 1 LIMIT {search.pool(10)}),
    lex AS (SELECT event_id, 1 / (1 + exp(-((-raw) - ({_X0})) / {_K})) AS lexical FROM bm WHERE workstream_id = 'ws-1' ORDER BY raw, event_id LIMIT {search.pool(10)}),
    uni AS (SELECT event_id, coalesce(semantic, 0.0) AS semantic, coalesce(lexical, 0.0) AS lexical FROM sem FULL JOIN lex USING (event_id)),
    {{subjects}}
    fu AS (SELECT event_id, semantic, lexical, subject, 0.65 * semantic + 0.35 * lexical + 0.2 * subject AS fused, CASE WHEN injected THEN 1.0 ELSE {REC} END AS recency, category, valid_at, created_at, statement,
      coalesce({PASS}, FALSE) AS allowed FROM un LEFT JOIN clog USING (event_id) LEFT JOIN cvis USING (event_id))"""
PLAINLY = "un AS (SELECT *, 0.0 AS subject, FALSE AS injected FROM uni),"
SUBJECTS = "subj AS (SELECT event_id FROM clog WHERE workstream_id = 'ws-1' AND category = 1 AND ({hit})), inj AS (SELECT event_id FROM subj WHERE event_id NOT IN (SELECT event_id FROM uni) ORDER BY event_id LIMIT 6), un AS (SELECT uni.*, CASE WHEN event_id IN (SELECT event_id FROM subj) THEN 1.0 ELSE 0.0 END AS subject, FALSE AS injected FROM uni UNION ALL SELECT event_id, 0.0, 0.0, 1.0, TRUE FROM inj),"
PARTS = ("semantic", "lexical", "subject", "fused", "recency", "score")
_PARTS = "event_id, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical, round(subject, 6) AS subject, round(fused, 6) AS fused, round(recency, 6) AS recency, round(fused * recency, 6) AS score"
HYBRID_PLAIN = HYBRID.replace("{subjects}", PLAINLY)
SUBJECT_KEYS = ["user1", "user7"]
_HIT = " OR ".join(f"contains('user' || (d % 20), '{k}') OR contains('{k}', 'user' || (d % 20))" for k in SUBJECT_KEYS)


def _hybrid(spark, d, **more):
    return search.hybrid(A.text_index(spark, d), A.corpus_events(spark, d), A.event_vectors(spark, d), _query_vector(spark, d), "test@64", gates.enforce(TOK1, CLOCK), SEARCH, A.NOW, **more)


@query(f"{HYBRID_PLAIN} SELECT {_PARTS} FROM fu WHERE fused >= 0.1 AND allowed ORDER BY fused * recency DESC, event_id LIMIT 10")
def hybrid_search(spark, d):
    return search.top(_hybrid(spark, d), 10).select("event_id", *(F.round(c, 6).alias(c) for c in PARTS))


@query(f"{HYBRID_PLAIN} SELECT {_PARTS}, fused >= 0.1 AND allowed AS kept FROM fu")
def hybrid_explain(spark, d):
    return _hybrid(spark, d).select("event_id", *(F.round(c, 6).alias(c) for c in PARTS), "kept")


_REASON = f"CASE WHEN event_channel <> 0 THEN 'channel' WHEN NOT {GATE.format(v='user-8')} THEN 'visibility' WHEN event_id IN (SELECT event_id FROM crev) THEN 'revoked' WHEN fused < 0.1 THEN 'score' END"


@query(f"{HYBRID_PLAIN}, fx AS (SELECT fu.event_id, fused, event_channel, clog.principal_id, visibility FROM fu JOIN clog USING (event_id) LEFT JOIN cvis USING (event_id)) SELECT event_id, round(fused, 6) AS fused, {_REASON} AS gate_reason FROM fx")
def hybrid_reasons(spark, d):
    out = search.explained(_hybrid(spark, d), A.corpus_events(spark, d), gates.enforce(TOK1, CLOCK))
    return out.select("event_id", F.round("fused", 6).alias("fused"), "gate_reason")


@query(f"{HYBRID.replace('{subjects}', SUBJECTS.format(hit=_HIT))} SELECT {_PARTS}, fused >= 0.1 AND allowed AS kept FROM fu")
def hybrid_subjects(spark, d):
    return _hybrid(spark, d, triples=A.corpus_triples(spark, d), keys=SUBJECT_KEYS).select("event_id", *(F.round(c, 6).alias(c) for c in PARTS), "kept")


@query(f"{HYBRID_PLAIN} SELECT 'hybrid' AS dispatcher, event_id, category, valid_at, created_at, CASE WHEN length(statement) <= 200 THEN statement ELSE substring(statement, 1, 200) || '…' END AS summary, round(fused * recency, 6) AS score FROM fu WHERE fused >= 0.1 AND allowed ORDER BY fused * recency DESC, event_id LIMIT 10")
def query_dispatch(spark, d):
    sources = dispatch.Sources(A.corpus_events(spark, d), A.text_index(spark, d), A.event_vectors(spark, d), "test@64", lambda _text: _query_vector(spark, d))
    out = dispatch.run(sources, TOK1, dispatch.Request(SEARCH, limit=10), CLOCK)
    return out.items.select(F.lit(out.dispatcher).alias("dispatcher"), "event_id", "category", "valid_at", "created_at", "summary", F.round("score", 6).alias("score"))


KEYS = ["user3", "user12"]


@query(f"{A.ctes('log')}, {TRIPLES} SELECT event_id, subject_key, predicate, object FROM tri WHERE " + " OR ".join(f"contains(subject_key, '{k}') OR contains('{k}', subject_key)" for k in KEYS))
def subject_match(spark, d):
    return search.subject_match(projections.triples(A.log(spark, d)), KEYS).select("event_id", "subject_key", "predicate", "object")


@query(ORACLES["subject_match"])
def subject_match_indexed(spark, d):
    return A.subject_index(spark, d).match(KEYS).select("event_id", "subject_key", "predicate", "object")


@query(ORACLES["vector_topk"])
def vector_topk_clusters(spark, d):
    """The same rows from clusters that are visited by bound; the query is the vector that the scan takes."""
    found = A.vector_index(spark, d).topk(_query_vector(spark, d).first()["q"], 25)
    return spark.createDataFrame([(k, round(s, 6)) for k, s in found], "vec_id long, cosine double")


@query(
    f"""{A.ctes('log', 'rev', 'vis')}, {TRIPLES}, m AS (SELECT tri.* FROM tri JOIN log USING (event_id) LEFT JOIN vis USING (event_id) WHERE ({" OR ".join(f"contains(subject_key, '{k}') OR contains('{k}', subject_key)" for k in KEYS)}) AND {GATE.format(v='user-8')} AND log.workstream_id = 'ws-1' AND event_channel = 0 AND event_id NOT IN (SELECT event_id FROM rev))
    SELECT subject_key, predicate, object, max(struct_pack(v := valid_at, e := event_id)).e AS event_id, max(valid_at) AS valid_at FROM m GROUP BY 1, 2, 3 ORDER BY max(struct_pack(v := valid_at, e := event_id)) DESC LIMIT 8"""
)
def triple_supplement(spark, d):
    events = search.Events(*sides(spark, d))
    return search.triple_supplement(projections.triples(events.log), events, gates.enforce(TOK1, CLOCK), KEYS, 25)


# ---- text --------------------------------------------------------------------------------------

_ANY_PII = " OR ".join(f"regexp_matches(text, '{p}')" for p in (X.EMAIL, X.SSN, X.PHONE))


@query(f"SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 WHEN {_ANY_PII} THEN 4 WHEN regexp_matches(text, '{X.CONFIDENTIAL}') THEN 2 WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END AS INT) AS classification FROM documents")
def classify(spark, d):
    return A.read(spark, d, "documents").select("doc_id", X.classify(F.col("text"), F.lit(False), F.col("doc_id") % 7).cast("int").alias("classification"))


@query(name="redact")
def redact_documents(spark, d):
    rows = A.read(spark, d, "documents").select("doc_id", redact(F.col("text")).alias("r"))
    return rows.select("doc_id", F.col("r.hits").alias("hits"), F.sha2("r.text", 256).alias("text_sha256"))


_LOW = "lower(trim(text, ' ' || chr(9) || chr(10) || chr(13)))"
_CUES = " ".join(f"WHEN {' OR '.join('contains(' + _LOW + ', ' + repr(c).replace(chr(34), chr(39)).replace(chr(39) + 'we' + chr(39) + 'll' + chr(39), chr(39) + 'we' + chr(39) * 2 + 'll' + chr(39)).replace(chr(39) + 'let' + chr(39) + 's' + chr(39), chr(39) + 'let' + chr(39) * 2 + 's' + chr(39)) + ')' for c in cues)} THEN '{name}'" for name, cues in X.CUES.items())
_DROP = " OR ".join(f"starts_with({_LOW}, '{c}')" for c in X.DROP)


@query(
    f"""{A.ctes('entries')}, c AS (SELECT *, CASE WHEN length({_LOW}) < 15 OR {_DROP} THEN 'dropped' {_CUES} ELSE 'fact' END AS outcome, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM entries WHERE {_LOW} <> '')
    SELECT session_id, entry_id, outcome, CASE WHEN outcome <> 'dropped' THEN CASE kind WHEN 0 THEN 'User' ELSE 'Agent' END || ': ' || {SUMMARY} END AS statement, entry_at FROM c"""
)
def heuristic_distill(spark, d):
    return sessions.distilled(A.entries(spark, d))


@query(f"{A.ctes('entries', 'marks')} SELECT session_id, entry_id, entry_at, kind FROM entries LEFT JOIN marks USING (session_id) WHERE last_entry IS NULL OR entry_id > last_entry")
def session_tail(spark, d):
    return sessions.tail(A.entries(spark, d), A.watermarks(spark, d)).select("session_id", "entry_id", "entry_at", "kind")


@query(f"{A.ctes('entries')} SELECT session_id, entry_id, CAST((row_number() OVER (PARTITION BY session_id ORDER BY entry_id) - 1) // 3 AS INT) AS chunk FROM entries")
def session_chunks(spark, d):
    return sessions.chunks(A.entries(spark, d), 3).select("session_id", "entry_id", "chunk")


# ---- bundles -----------------------------------------------------------------------------------


def _bundle_events(spark, d):
    log, rev, _ = sides(spark, d)
    return bundle.scored_events(log, rev, A.curations(spark, d), A.NOW)


SCORED = f"""{A.ctes('log', 'rev', 'cur')}, {MULT}, {AMEND}, sc AS (
    SELECT workstream_id, event_id, category, valid_at, CASE WHEN skill_name IS NOT NULL THEN skill_name || ' — ' || statement ELSE coalesce(amended, statement) END AS text,
      round(least(1.0, greatest(0.0, exp(-greatest(0.0, (epoch_us(TIMESTAMP '{A.NOW}') - epoch_us(created_at)) / 86400000000.0) / 30) * coalesce(multiplier, 1.0))), 9) AS score
    FROM log LEFT JOIN mul ON event_id = mul.target_id LEFT JOIN ame ON event_id = ame.target_id WHERE event_channel = 0 AND event_id NOT IN (SELECT event_id FROM rev))"""
_CUT = "CASE WHEN length({c}) <= {n} THEN {c} ELSE substring({c}, 1, {n}) || '…' END"
_EST = "(length({c}) + 3) // 4"
_RANK = "CASE category WHEN 2 THEN 0 WHEN 4 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 5 WHEN 0 THEN 6 ELSE 99 END"
PACKED = f"""{SCORED}, ln AS (SELECT *, {_EST.format(c="('- ' || " + _CUT.format(c='text', n=200) + " || ' [' || event_id || ']')")} AS tok, row_number() OVER (PARTITION BY workstream_id, category ORDER BY score DESC, valid_at DESC, event_id) AS p FROM sc),
    gr AS (SELECT workstream_id, category, list(tok ORDER BY p) AS t FROM ln GROUP BY 1, 2),
    us AS (SELECT workstream_id, category, unnest(range(1, len(t) + 1)) AS p, unnest(list_transform(range(1, len(t) + 1), lambda i: list_reduce(list_prepend(CAST(0 AS BIGINT), t[1:i - 1]), lambda a, x: CASE WHEN a + x <= 512 THEN a + x ELSE a END))) AS used FROM gr),
    pk AS (SELECT ln.*, used + tok <= 512 AS fits, CAST({_RANK} AS INT) AS rank FROM ln JOIN us USING (workstream_id, category, p))"""


@query(f"{PACKED} SELECT workstream_id, category, count(*) FILTER (WHERE fits) AS n_lines, CAST(sum(tok) FILTER (WHERE fits) AS BIGINT) AS tokens, count(*) AS n_events, rank FROM pk GROUP BY workstream_id, category, rank HAVING count(*) FILTER (WHERE fits) > 0")
def bundle_sections(spark, d):
    return bundle.sections(_bundle_events(spark, d))


@query(
    f"""{PACKED}, hi AS (SELECT workstream_id, event_id, category, rank, p, lower(array_to_string(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')[1:3], '-')) AS keyword, {_CUT.format(c='text', n=80)} AS context FROM pk WHERE NOT fits),
    ru AS (SELECT *, CAST(sum({_EST.format(c='keyword')} + {_EST.format(c='context')}) OVER (PARTITION BY workstream_id ORDER BY rank, p) AS BIGINT) AS running FROM hi)
    SELECT workstream_id, event_id, category, keyword, context, running FROM ru WHERE running <= 256"""
)
def bundle_hints(spark, d):
    return bundle.hints(_bundle_events(spark, d))


@query(
    f"""{PACKED}, se AS (SELECT workstream_id, category, count(*) AS n, sum(tok) FILTER (WHERE fits) AS t FROM pk GROUP BY 1, 2 HAVING count(*) FILTER (WHERE fits) > 0), s AS (SELECT workstream_id, count(*) AS n_sections, sum(n) AS n_events, sum(t) AS t FROM se GROUP BY 1),
    hi AS (SELECT workstream_id, rank, p, lower(array_to_string(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')[1:3], '-')) AS keyword, {_CUT.format(c='text', n=80)} AS context FROM pk WHERE NOT fits),
    ru AS (SELECT *, sum({_EST.format(c='keyword')} + {_EST.format(c='context')}) OVER (PARTITION BY workstream_id ORDER BY rank, p) AS running FROM hi), h AS (SELECT workstream_id, count(*) AS n_hints, max(running) AS t FROM ru WHERE running <= 256 GROUP BY 1)
    SELECT workstream_id, n_sections, coalesce(n_hints, 0) AS n_hints, CAST(s.t + coalesce(h.t, 0) + (length('A plain list of ' || n_events || ' events in ' || n_sections || ' categories, best first; nothing has been summarised.') + 3) // 4 AS BIGINT) AS token_count FROM s LEFT JOIN h USING (workstream_id)"""
)
def bundle_totals(spark, d):
    return bundle.totals(_bundle_events(spark, d))


@query(f"{A.ctes('log')} SELECT workstream_id, workstream_id IN ('ws-1', 'ws-0') AS stale FROM (SELECT DISTINCT workstream_id FROM log)")
def bundle_stale(spark, d):
    """Cached bundles of the latest event, but one of another event and one made before a curation."""
    now, ws = scans.latest(A.log(spark, d)), F.col("workstream_id")
    cached = now.select("workstream_id", F.when(ws == "ws-1", F.lit("ev-other")).otherwise(F.col("event_id")).alias("covered_through"), F.when(ws == "ws-0", F.lit("2000-01-01")).otherwise(F.lit("2100-01-01")).cast("timestamp_ntz").alias("generated_at"))
    return bundle.stale(cached, A.log(spark, d), A.curations(spark, d))


@query(f"{SCORED} SELECT * FROM sc")
def bundle_scores(spark, d):
    return _bundle_events(spark, d)


# ---- entities ----------------------------------------------------------------------------------

_LOCAL, _HOST = "split_part(lower(trim(raw)), '@', 1)", "split_part(lower(trim(raw)), '@', 2)"
CANON = f"CASE WHEN {_HOST} IN ('gmail.com', 'googlemail.com') THEN replace({_LOCAL}, '.', '') || '@gmail.com' ELSE {_LOCAL} || '@' || {_HOST} END"
_H = f"sha1('eventloom:entity:ws-1:0:' || {CANON})"
ENTITY_ID = (
    f"'ent-' || substr({_H}, 7, 2) || substr({_H}, 5, 2) || substr({_H}, 3, 2) || substr({_H}, 1, 2) || substr({_H}, 11, 2) || substr({_H}, 9, 2) || substr({_H}, 15, 2) || '5' || substr({_H}, 14, 1) "
    f"|| substr('89ab', ((instr('0123456789abcdef', substr({_H}, 17, 1)) - 1) % 4) + 1, 1) || substr({_H}, 18, 1) || substr({_H}, 19, 14)"
)


@query(f"{A.ctes('ent')} SELECT c_custkey, {CANON} AS canonical, {ENTITY_ID} AS entity_id FROM ent")
def entity_canonical(spark, d):
    raw = A.entities(spark, d).select("c_custkey", F.lit("ws-1").alias("workstream_id"), F.lit("email").alias("kind"), "raw")
    return entities.resolved(raw).select("c_custkey", "canonical", "entity_id")


@query("SELECT o_custkey AS c_custkey, count(*) AS mention_count, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY o_custkey")
def entity_mentions(spark, d):
    return entities.mention_stats(A.mentions(spark, d), "c_custkey").drop("weight")


@query("SELECT o_custkey AS c_custkey, round(1 / (1 + 0.001 * (count(*) - 1) * (count(*) - 1)), 9) AS weight FROM orders GROUP BY o_custkey")
def popularity(spark, d):
    return entities.mention_stats(A.mentions(spark, d), "c_custkey").select("c_custkey", F.round("weight", 9).alias("weight"))


@query("SELECT c_custkey, upper(sha256('v1|kind=0|key=' || lower(c_name) || '|name=' || c_name || '|mentions=' || c_nationkey)) AS hash FROM customer")
def entity_state_hash(spark, d):
    return A.read(spark, d, "customer").select("c_custkey", entities.state_hash(F.lit(0), F.lower("c_name"), F.col("c_name"), F.col("c_nationkey")).alias("hash"))


@query(f"{A.ctes('log')}, {TRIPLES} SELECT workstream_id, subject_key, min(event_id) AS first_event FROM tri GROUP BY 1, 2")
def first_subjects(spark, d):
    return entities.first_subjects(projections.triples(A.log(spark, d)))


# ---- consolidation and sync --------------------------------------------------------------------

OUT = "outp AS (SELECT event_id AS output_id, supporting AS sources, CAST(e % 4 AS INT) AS proposed FROM log WHERE category IN (1, 2))"


def _outputs(spark, d):
    return A.log(spark, d).where("category in (1, 2)").selectExpr("event_id as output_id", "supporting as sources", "cast(e % 4 as int) as proposed")


ELIGIBLE = f"{A.ctes('log')}, {OUT}, el AS (SELECT output_id, bool_and(coalesce(classification IN (0, 1), FALSE)) AS eligible FROM (SELECT output_id, unnest(sources) AS event_id FROM outp) LEFT JOIN log USING (event_id) GROUP BY output_id)"


@query(f"{ELIGIBLE} SELECT output_id, eligible FROM el")
def promotion_eligible(spark, d):
    return consolidate.promotion_eligible(_outputs(spark, d), A.log(spark, d))


@query(f"{ELIGIBLE} SELECT output_id, eligible, CAST(CASE WHEN eligible THEN least(proposed, 2) ELSE 0 END AS INT) AS visibility FROM outp JOIN el USING (output_id)")
def visibility_cap(spark, d):
    outputs = _outputs(spark, d)
    return consolidate.capped_visibility(outputs.join(consolidate.promotion_eligible(outputs, A.log(spark, d)), "output_id")).select("output_id", "eligible", "visibility")


@query(f"{A.ctes('log', 'rev', 'vis')}, {OUT}, x AS (SELECT output_id, unnest(sources) AS event_id FROM outp) SELECT output_id, event_id, category, statement FROM x JOIN log USING (event_id) LEFT JOIN vis USING (event_id) WHERE workstream_id = 'ws-1' AND {GATE.format(v='user-8')} AND event_id NOT IN (SELECT event_id FROM rev)")
def citation_sources(spark, d):
    return consolidate.citation_sources(_outputs(spark, d), *sides(spark, d), gates.enforce(TOK1, CLOCK))


@query(
    f"""{A.ctes('log', 'vis')}, {TRIPLES}, v AS (SELECT event_id FROM log LEFT JOIN vis USING (event_id) WHERE {GATE.format(v='user-8')})
    SELECT a.event_id AS event_a, b.event_id AS event_b, a.subject_key, a.predicate FROM tri a JOIN tri b ON a.workstream_id = b.workstream_id AND a.subject_key = b.subject_key AND a.predicate = b.predicate AND a.event_id < b.event_id AND lower(trim(a.object)) <> lower(trim(b.object))
    WHERE a.event_id IN (SELECT event_id FROM v) AND b.event_id IN (SELECT event_id FROM v)"""
)
def visible_contradictions(spark, d):
    log, _, vis = sides(spark, d)
    return consolidate.contradictions_seen(projections.triples(log), log, vis, "user-8").select("event_a", "event_b", "subject_key", "predicate")


@query(f"{A.ctes('log')} SELECT event_id, workstream_id, category, statement FROM log WHERE e % 3 <> 0 OR e % 2 = 0")
def sync_union(spark, d):
    log = A.log(spark, d)
    columns = ("event_id", "workstream_id", "category", "statement")
    return sync.union(log.where("e % 3 <> 0").select(*columns), log.where("e % 2 = 0").select(*columns))


@query(
    f"""{A.ctes('log', 'rev', 'vis')}, s AS (SELECT workstream_id, event_id, skill_name AS name, statement AS procedure, valid_at, row_number() OVER (PARTITION BY workstream_id ORDER BY valid_at DESC, event_id) AS p
      FROM log LEFT JOIN vis USING (event_id) WHERE category = 0 AND skill_name IS NOT NULL AND workstream_id IN ('ws-1', 'ws-2', 'ws-3') AND coalesce(visibility, 1) >= 1 AND event_id NOT IN (SELECT event_id FROM rev))
    SELECT workstream_id, event_id, name, procedure, valid_at FROM s WHERE p <= 20"""
)
def pooled_skills(spark, d):
    log, rev, vis = sides(spark, d)
    return consolidate.pooled_skills(projections.skills(log, rev), rev, vis, ["ws-1", "ws-2", "ws-3"], each=20).select("workstream_id", "event_id", "name", "procedure", "valid_at")


# ---- evaluation --------------------------------------------------------------------------------

PAIRS = "pr AS (SELECT a.conv_id, a.turn, a.text AS answer, b.text AS gold FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_TOK = "list_distinct(list_filter(string_split_regex(lower({c}), '[ \\t\\n\\r.,!?;:\"'']+'), lambda x: x <> ''))"
F1 = f"CASE WHEN len(g) = 0 THEN CASE WHEN len(a) = 0 THEN 1.0 ELSE 0.0 END WHEN len(a) = 0 THEN 0.0 WHEN contains(lower(answer), lower(gold)) THEN 1.0 ELSE 2.0 * len(list_intersect(a, g)) / (len(a) + len(g)) END"
TF1 = f"WITH {PAIRS}, tk AS (SELECT *, {_TOK.format(c='answer')} AS a, {_TOK.format(c='gold')} AS g FROM pr), f AS (SELECT conv_id, turn, CAST({F1} AS DOUBLE) AS f1, answer FROM tk)"


def _graded(spark, d):
    c = A.read(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return c.select("conv_id", "turn", F.col("text").alias("answer")).join(nxt, ["conv_id", "turn"]).withColumn("f1", X.token_f1(F.col("answer"), F.col("gold")))


@query(f"{TF1} SELECT conv_id, turn, round(f1, 6) AS f1, f1 >= 0.5 AS correct FROM f")
def token_f1(spark, d):
    return _graded(spark, d).select("conv_id", "turn", F.round("f1", 6).alias("f1"), (F.col("f1") >= 0.5).alias("correct"))


@query(
    f"""{TF1}, c AS (SELECT CAST(conv_id % 5 + 1 AS INT) AS category, f1 >= 0.1 AS correct, CAST(length(answer) AS DOUBLE) AS tokens FROM f), x AS (SELECT CAST(category AS VARCHAR) AS part, * FROM c UNION ALL SELECT 'all', * FROM c UNION ALL SELECT 'all but 5', * FROM c WHERE category <> 5)
    SELECT part, count(*) AS total, count(*) FILTER (WHERE correct) AS "right", round(avg(CAST(correct AS DOUBLE)), 6) AS ratio, round(avg(tokens), 6) AS mean_tokens FROM x GROUP BY part"""
)
def eval_by_category(spark, d):
    return evaluation.accuracy(_graded(spark, d).select((F.col("conv_id") % 5 + 1).cast("int").alias("category"), (F.col("f1") >= 0.1).alias("correct"), F.length("answer").cast("double").alias("tokens")))


@query(
    """WITH c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn),
    tok AS (SELECT conv_id, turn, 'conv-' || conv_id || '-' || turn AS event_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM c),
    tf AS (SELECT conv_id, event_id, term, len(t) AS dl, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM tok) GROUP BY conv_id, event_id, term, t),
    st AS (SELECT conv_id, count(DISTINCT event_id) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT conv_id, event_id, dl FROM tf) GROUP BY conv_id),
    df AS (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY conv_id, term),
    q AS (SELECT conv_id, term, count(*) AS times FROM (SELECT conv_id, unnest(t[1:6]) AS term FROM tok WHERE turn = 0) GROUP BY conv_id, term),
    s AS (SELECT q.conv_id, event_id, round(sum(times * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN tf USING (conv_id, term) JOIN df USING (conv_id, term) JOIN st USING (conv_id) GROUP BY q.conv_id, event_id)
    SELECT 'conv-' || conv_id AS question_id, event_id, round(score, 6) AS score, CAST(p AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, event_id) AS p FROM s) WHERE p <= 3"""
)
def question_retrieval(spark, d):
    """A question for each conversation, the first six words of its first turn, over the conversation's own turns."""
    turns = A.read(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).selectExpr("'conv-' || conv_id || '-' || turn as event_id", "'conv-' || conv_id as workstream_id", "cast('2024-01-01' as timestamp_ntz) as created_at", "text as content", "turn")
    words = F.slice(X.terms(F.col("content")), 1, 6)
    asked = turns.where("turn = 0").select(F.col("workstream_id").alias("question_id"), "workstream_id", F.array_join(words, " ").alias("query"))
    return evaluation.retrieved(textindex.indexed(turns), asked, 3).select("question_id", "event_id", F.round("score", 6).alias("score"), "place")


@query("SELECT l_returnflag, l_extendedprice AS p95 FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE i = greatest(1, n * 95 // 100)")
def percentile_exact(spark, d):
    return evaluation.percentile(A.read(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", 95)


# ---- upkeep and views --------------------------------------------------------------------------


@query(f"{A.ctes('log', 'rev')} SELECT event_id, workstream_id FROM log WHERE event_id NOT IN (SELECT event_id FROM rev) AND e NOT IN (SELECT vec_id FROM embeddings)")
def pending_embeddings(spark, d):
    have = A.vectors(spark, d).select(F.expr(A.ev("vec_id")).alias("event_id"), "provider_id")
    log, rev, _ = sides(spark, d)
    return maintenance.pending_embeddings(log, rev, have, "test@64").select("event_id", "workstream_id")


@query(
    f"""{A.ctes('log')}, {TRIPLES}, ch AS (SELECT workstream_id, event_id AS d FROM log WHERE category = 2 UNION SELECT workstream_id, decision_ref FROM log WHERE category = 5 AND decision_ref IS NOT NULL)
    SELECT 'facts' AS projection, count(*) AS n FROM log WHERE category = 1 UNION ALL SELECT 'decisions', count(*) FROM log WHERE category = 2 UNION ALL SELECT 'hypotheses', count(*) FROM log WHERE category = 3
    UNION ALL SELECT 'goals', count(*) FROM log WHERE category = 4 UNION ALL SELECT 'skills', count(*) FROM log WHERE category = 0 AND skill_name IS NOT NULL UNION ALL SELECT 'triples', count(*) FROM tri
    UNION ALL SELECT 'contradictions', count(*) FROM tri a JOIN tri b ON a.workstream_id = b.workstream_id AND a.subject_key = b.subject_key AND a.predicate = b.predicate AND a.event_id < b.event_id AND lower(trim(a.object)) <> lower(trim(b.object))
    UNION ALL SELECT 'duplicates', CAST(sum(n * (n - 1) / 2) AS BIGINT) FROM (SELECT count(*) AS n FROM log WHERE category = 1 GROUP BY workstream_id, lower(trim(statement))) UNION ALL SELECT 'decision_chains', count(*) FROM ch"""
)
def rebuild_counts(spark, d):
    return maintenance.rebuild_counts(A.log(spark, d), A.revocations(spark, d))


@query(
    f"""{A.ctes('log', 'rev')}, k AS (SELECT * FROM log WHERE workstream_id = 'ws-2' ORDER BY created_at DESC, event_id LIMIT 200)
    SELECT event_id, workstream_id, (['Evidence', 'Fact', 'Decision', 'Hypothesis', 'Goal', 'Action', 'Outcome'])[category + 1] AS category, (['Public', 'Internal', 'Confidential', 'Secret', 'Pii'])[classification + 1] AS classification, created_at, revoked_at IS NOT NULL AS revoked FROM k LEFT JOIN rev USING (event_id)"""
)
def recent_events(spark, d):
    return maintenance.recent_events(A.log(spark, d), A.revocations(spark, d), 200, "ws-2")


@query(f"{A.ctes('log', 'rev')} SELECT 'goals' AS projection, workstream_id, event_id, statement, valid_at, revoked_at IS NOT NULL AS revoked FROM log LEFT JOIN rev USING (event_id) WHERE category = 4 ORDER BY valid_at DESC, event_id LIMIT 100")
def projection_page(spark, d):
    return maintenance.projection_page(maintenance.rebuilt(A.log(spark, d), A.revocations(spark, d)), "goals", 100)


@query(f"{HYBRID_PLAIN} SELECT 'hybrid' AS dispatcher, 'viewer=user-8 workstream=ws-1 channel=0 categories=0,1,2,3,4,5,6' AS capability, count(*) AS considered, count(*) FILTER (WHERE fused >= 0.1 AND allowed) AS kept, count(*) FILTER (WHERE NOT (fused >= 0.1 AND allowed)) AS gated FROM fu")
def explain_counts(spark, d):
    sources = dispatch.Sources(A.corpus_events(spark, d), A.text_index(spark, d), A.event_vectors(spark, d), "test@64", lambda _text: _query_vector(spark, d))
    return dispatch.run(sources, TOK1, dispatch.Request(SEARCH, limit=10, explain=True), CLOCK).explain


@query(f"{A.ctes('corpus')}, {BM25}, p AS (SELECT event_id, row_number() OVER (ORDER BY raw, event_id) AS place FROM bm QUALIFY place <= 50), r AS (SELECT 'doc-' || vec_id AS event_id, round({COS}, 9) AS score FROM embeddings) SELECT event_id, place FROM p LEFT JOIN r USING (event_id) ORDER BY score DESC NULLS LAST, place, event_id LIMIT 10")
def rerank(spark, d):
    from pyspark.sql import Window as W

    best = textindex.bm25(A.text_index(spark, d), SEARCH).orderBy("raw_score", "event_id").limit(50)
    placed = best.select("event_id", F.row_number().over(W.orderBy("raw_score", "event_id")).cast("long").alias("place"))
    scores = search.vector_topk(A.vectors(spark, d), _query_vector(spark, d), 1 << 30).select(F.concat(F.lit("doc-"), F.col("vec_id")).alias("event_id"), F.round("cosine", 9).alias("score"))
    return maintenance.reranked(placed, scores, 10)


_STOP = ", ".join(f"'{w}'" for w in X.GOLD_STOP)


@query(
    f"""WITH {PAIRS}, g AS (SELECT *, list_filter(string_split_regex(lower(gold), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS t FROM pr)
    SELECT conv_id, turn, len(t) > 0 AND len(list_filter(t, lambda w: contains(lower(answer), w))) / greatest(len(t), 1) >= 0.6 AS supported FROM g"""
)
def gold_support(spark, d):
    return _graded(spark, d).select("conv_id", "turn", X.gold_support(F.col("answer"), F.col("gold")).alias("supported"))


# ---- payloads, upkeep and views of round two ----------------------------------------------------

_KINDS = "['evidence', 'fact', 'decision', 'hypothesis', 'goal', 'action', 'outcome']"


def _payloads(spark, d):
    """The log's statements as typed payloads; the skills among the evidence have a name."""
    log = A.log(spark, d)
    kind = F.when(F.col("skill_name").isNotNull(), F.lit("skill")).otherwise(F.element_at(F.array(*[F.lit(k) for k in P.VARIANTS if k != "skill"]), F.col("category") + 1))
    body = F.to_json(F.struct(
        kind.alias("$type"), F.when(kind == "evidence", F.col("statement")).alias("content"), F.when(~kind.isin("evidence", "skill"), F.col("statement")).alias("statement"), F.when(kind == "decision", F.col("subject")).alias("rationale"),
        F.when((kind == "action") & (F.col("e") % 2 == 0), F.col("predicate")).alias("externalReference"), F.when(kind == "skill", F.col("skill_name")).alias("name"), F.when(kind == "skill", F.col("statement")).alias("procedure"), F.when((kind == "skill") & (F.col("e") % 3 == 0), F.col("subject")).alias("trigger"),
    ))
    return log.select("event_id", P.parsed(body).alias("p"))


PAY = f"""pay AS (SELECT event_id, e, CASE WHEN skill_name IS NOT NULL THEN 'skill' ELSE ({_KINDS})[category + 1] END AS k, statement, subject, predicate, skill_name FROM log)"""


@query(f"{A.ctes('log')}, {PAY} SELECT event_id, k AS kind, CASE WHEN k = 'skill' THEN 'Skill: ' || skill_name ELSE statement END AS summary FROM pay")
def payload_summaries(spark, d):
    return _payloads(spark, d).select("event_id", P.kind(F.col("p")).alias("kind"), P.summary(F.col("p")).alias("summary"))


@query(
    f"""{A.ctes('log')}, {PAY} SELECT event_id, CASE k WHEN 'skill' THEN skill_name || chr(10) || statement || CASE WHEN e % 3 = 0 THEN chr(10) || subject ELSE '' END WHEN 'decision' THEN statement || chr(10) || subject ELSE statement END AS classifier_text,
    CASE k WHEN 'skill' THEN skill_name || ' ' || statement || ' ' || CASE WHEN e % 3 = 0 THEN subject ELSE '' END WHEN 'decision' THEN statement || ' ' || subject WHEN 'action' THEN statement || ' ' || CASE WHEN e % 2 = 0 THEN predicate ELSE '' END ELSE statement END AS index_text,
    CASE WHEN k = 'skill' THEN '' ELSE statement END AS embed_text, CASE k WHEN 'skill' THEN skill_name || ' — ' || statement WHEN 'decision' THEN statement || ' — ' || subject ELSE statement END AS bundle_text FROM pay"""
)
def payload_texts(spark, d):
    p = F.col("p")
    return _payloads(spark, d).select("event_id", P.classifier_text(p).alias("classifier_text"), P.index_text(p).alias("index_text"), P.embed_text(p).alias("embed_text"), P.bundle_text(p).alias("bundle_text"))


@query(f"{A.ctes('log')}, m AS (SELECT unnest([struct_pack(projection := 'facts', place := 0, c := 1), struct_pack(projection := 'decisions', place := 1, c := 2), struct_pack(projection := 'hypotheses', place := 2, c := 3), struct_pack(projection := 'goals', place := 3, c := 4), struct_pack(projection := 'skills', place := 4, c := 0), struct_pack(projection := 'triples', place := 5, c := 1), struct_pack(projection := 'contradictions', place := 6, c := 1), struct_pack(projection := 'duplicates', place := 7, c := 1), struct_pack(projection := 'decision_chains', place := 8, c := 2), struct_pack(projection := 'decision_chains', place := 8, c := 5), struct_pack(projection := 'decision_chains', place := 8, c := 6)], recursive := true)) SELECT event_id, projection, place, 'Applied' AS status FROM log JOIN m ON category = c")
def processing_log(spark, d):
    return maintenance.processing_log(A.log(spark, d)).select("event_id", "projection", "place", "status")


@query(f"{A.ctes('log')}, f AS (SELECT workstream_id, event_id, created_at, lower(trim(statement)) AS k FROM log WHERE category = 1), g AS (SELECT workstream_id, k, min(struct_pack(c := created_at, i := event_id)).i AS canonical_event, count(*) AS group_size FROM f GROUP BY 1, 2 HAVING count(*) > 1) SELECT workstream_id, event_id, canonical_event, group_size FROM f JOIN g USING (workstream_id, k)")
def duplicate_groups(spark, d):
    return projections.duplicate_groups(A.log(spark, d))


@query(f"{A.ctes('cur')} SELECT curation_id, target_id, (['Amend', 'Annotate', 'Pin', 'Demote', 'Revert'])[kind + 1] AS kind, curator, occurred_at, reverted FROM cur ORDER BY occurred_at DESC, curation_id LIMIT 150")
def curation_list(spark, d):
    return maintenance.curation_list(A.curations(spark, d), 150)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE toxic = 0) AS hits, avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END) AS recall FROM labels")
def probe_recall(spark, d):
    return evaluation.recall(A.read(spark, d, "labels").select((F.col("toxic") == 0).alias("hit")))


@query(f"{A.ctes('log', 'rev')}, r AS (SELECT *, row_number() OVER (PARTITION BY workstream_id ORDER BY valid_at DESC, event_id) AS p FROM log WHERE category = 1 AND event_id NOT IN (SELECT event_id FROM rev)) SELECT workstream_id, event_id, statement FROM r WHERE p <= 50")
def prior_facts(spark, d):
    return sessions.prior_facts(A.log(spark, d), A.revocations(spark, d)).select("workstream_id", "event_id", "statement")


@query(f"{A.ctes('log')} SELECT event_id, '[' || strftime(valid_at, '%Y-%m-%d') || '] ' || statement AS snippet, replace(predicate, '_', ' ') AS predicate, round(1 + 0.1 * (CAST(contains(lower(statement), 'user 3') AS INT) + CAST(contains(lower(statement), 'purchase') AS INT)), 6) AS boost, CAST(ceil(len(list_filter(string_split_regex(statement, '\\s+'), lambda w: w <> '')) / 0.75) AS BIGINT) AS tokens FROM log")
def snippets(spark, d):
    s = F.col("statement")
    return A.log(spark, d).select("event_id", evaluation.dated_snippet(F.col("valid_at"), s).alias("snippet"), evaluation.humanised(F.col("predicate")).alias("predicate"), F.round(evaluation.entity_boost(s, ["User 3", "purchase"]), 6).alias("boost"), evaluation.harness_tokens(s).alias("tokens"))
