"""Test tables as engine inputs: the event log with its sidecars, curations, reviews, sessions, corpus, vectors, entities.

Each derivation has a DuckDB twin in ``SQL``, so that queries and their oracles start from equal rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The evaluation clock of all queries.
NOW = "2024-02-01 00:00:00"
REVIEW_NOW = "2024-01-20 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(expression: str) -> str:
    return f"'ev-' || lpad(cast({expression} as string), 9, '0')"


_FIELDS = [
    ("event_id", ev("event_id")),
    ("e", "event_id"),
    ("b", "cast(floor(event_id / 7) as bigint)"),
    ("workstream_id", "'ws-' || (cast(floor(event_id / 7) as bigint) % 5)"),
    ("principal_id", "'user-' || user_id"),
    ("category", "cast(event_id % 7 as int)"),
    ("event_channel", "cast(case when event_id % 97 = 0 then 1 else 0 end as int)"),
    ("created_at", "ts"),
    ("valid_at", "ts - make_dt_interval(cast(event_id % 5 as int))"),
    ("invalid_at", "case when event_id % 11 = 0 then ts + make_dt_interval(3) end"),
    ("classification", "cast(case when event_id % 10 = 0 then 4 when event_id % 10 = 1 then 2 when event_id % 7 = 0 then 0 else 1 end as int)"),
    ("statement", "case when event_id % 3 = 0 then upper('user ' || (user_id % 20) || ' ' || event_type || ' ' || cast(floor(value / 50) as int)) else 'user ' || (user_id % 20) || ' ' || event_type || ' ' || cast(floor(value / 50) as int) end"),
    ("subject", "'User' || (user_id % 20) || case when event_id % 4 = 0 then \"'s team\" else '' end"),
    ("predicate", "event_type"),
    ("object", "'tier ' || cast(floor(value / 50) as int)"),
    ("decision_ref", f"case when event_id % 7 = 5 then case when floor(event_id / 7) % 4 = 1 and floor(event_id / 7) >= 5 then {ev('event_id - 38')} else {ev('event_id - 3')} end end"),
    ("action_ref", f"case when event_id % 7 = 6 then {ev('event_id - 1')} end"),
    ("polarity", "case when event_id % 7 = 6 then cast(cast(floor(event_id / 7) as bigint) % 3 as int) - 1 end"),
    ("supporting", f"case when event_id % 7 in (1, 2) then array({ev('event_id - 1')}) end"),
    ("skill_name", "case when event_id % 28 = 0 then event_type end"),
]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log; columns that a query does not use cost nothing."""
    return read(spark, sf_dir, "events").selectExpr(*(f"{sql} as {name}" for name, sql in _FIELDS))


def revocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("event_id % 17 = 0").selectExpr(f"{ev('event_id')} as event_id", "ts + make_dt_interval(1) as revoked_at")


def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    private = "case when event_id % 10 = 0 or event_id % 10 = 1 then 0 else 1 end"
    return read(spark, sf_dir, "events").where("event_id % 13 <> 0").selectExpr(f"{ev('event_id')} as event_id", f"cast({private} as int) as visibility")


def curations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("event_id % 19 = 0").selectExpr(
        "'cur-' || event_id as curation_id",
        f"{ev('event_id - (event_id % 70) + 1')} as target_id",
        "cast(cast(floor(event_id / 7) as bigint) % 4 as int) as kind",
        "case cast(floor(event_id / 7) as bigint) % 4 when 2 then 2.0D when 3 then 0.30000001192092896D end as multiplier",
        "'amended ' || event_id as new_content",
        "ts + make_dt_interval(2) as occurred_at",
        "event_id % 5 = 0 as reverted",
        "'user-' || user_id as curator",
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("category = 1 and e % 6 = 0").selectExpr(
        "event_id", "workstream_id", "element_at(array('pending', 'approved', 'rejected', 'deferred'), cast(b % 4 as int) + 1) as status", "created_at as captured_at", "created_at + make_dt_interval(cast(e % 10 as int)) as defer_until", "substring(statement, 1, 200) as summary"
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("event_id"), F.concat(F.lit("ws-"), F.col("doc_id") % 5).alias("workstream_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))").alias("created_at"), F.col("text").alias("content")
    )


_CORPUS_FIELDS = [
    ("event_id", "'doc-' || doc_id"),
    ("d", "doc_id"),
    ("workstream_id", "'ws-' || (doc_id % 5)"),
    ("principal_id", "'user-' || (doc_id % 50)"),
    ("category", "cast(doc_id % 7 as int)"),
    ("event_channel", "cast(case when doc_id % 97 = 0 then 1 else 0 end as int)"),
    ("created_at", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))"),
    ("valid_at", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 20 as int))"),
    ("invalid_at", "case when doc_id % 11 = 0 then timestamp_ntz'2024-01-15 00:00:00' end"),
    ("statement", "text"),
    ("skill_name", "cast(null as string)"),
]


def corpus_events(spark: SparkSession, sf_dir: str):
    """Documents as a log with sidecars, for the gates of free-text search."""
    from .operators.search import Events

    docs = read(spark, sf_dir, "documents")
    log_ = docs.selectExpr(*(f"{sql} as {name}" for name, sql in _CORPUS_FIELDS))
    gone = docs.where("doc_id % 17 = 0").selectExpr("'doc-' || doc_id as event_id", "timestamp_ntz'2024-01-20 00:00:00' as revoked_at")
    seen = docs.where("doc_id % 13 <> 0").selectExpr("'doc-' || doc_id as event_id", "cast(case when doc_id % 10 in (0, 1) then 0 else 1 end as int) as visibility")
    return Events(log_, gone, seen)


def corpus_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One triple for each document whose category is a fact."""
    return corpus_events(spark, sf_dir).log.where("category = 1").selectExpr("workstream_id", "event_id", "'user' || (d % 20) as subject_key", "'writes' as predicate", "cast(d % 3 as string) as object", "valid_at")


_KEPT: dict = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build):
    """What ``build`` makes in a folder of its own: once for an application and data set, as ingestion would, then read."""
    from .workspace import workspace

    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = build(f"{workspace(spark)}/{name}/{len(_KEPT)}-{uuid.uuid4().hex}")
    return _KEPT[key]


def text_index(spark: SparkSession, sf_dir: str):
    """The full-text index of the documents."""
    from .operators.textindex import IndexStore

    def build(folder: str):
        store = IndexStore(spark, folder)
        store.add(corpus(spark, sf_dir))
        return store.index()

    return kept(spark, sf_dir, "text", build)


def subject_index(spark: SparkSession, sf_dir: str):
    """The log's triples by subject, with the pieces of subject keys."""
    from .operators.projections import triples
    from .operators.subjects import SubjectIndex

    def build(folder: str):
        index = SubjectIndex(spark, folder, 16)
        index.add(triples(log(spark, sf_dir)))
        return index

    return kept(spark, sf_dir, "subjects", build)


def vector_index(spark: SparkSession, sf_dir: str, clusters: int = 64):
    """The vectors in clusters."""
    from .operators.subjects import VectorIndex

    return kept(spark, sf_dir, "vectors", lambda folder: VectorIndex(vectors(spark, sf_dir), "vec_id", clusters, folder))


def event_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc-"), F.col("vec_id")).alias("event_id"), F.lit("test@64").alias("provider_id"), "embedding")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.lit("test@64").alias("provider_id"), "embedding")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").selectExpr(
        "'conv-' || conv_id as session_id",
        "lpad(cast(turn as string), 6, '0') as entry_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(conv_id as int), 0, cast(turn as int)) as entry_at",
        "case role when 'user' then 0 when 'assistant' then 1 else 6 end as kind",
        "text",
        "conv_id",
        "turn",
    )


def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("conv_id % 2 = 0").selectExpr("'conv-' || conv_id as session_id", "'000001' as last_entry").distinct()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr("c_custkey", "replace(c_name, '#', '.') || '@' || case when c_custkey % 2 = 0 then 'gmail.com' else 'example.com' end as raw")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_custkey as c_custkey", "'ord-' || o_orderkey as event_id", "o_orderdate as seen_at")


def _duck(sql: str) -> str:
    import re

    sql = sql.replace("make_dt_interval(0, 0, cast(doc_id as int))", "to_minutes(doc_id)").replace("timestamp_ntz'", "timestamp '").replace("null as string", "null as varchar")
    sql = re.sub(r"make_dt_interval\(((?:[^()]|\([^()]*\))*)\)", r"to_days(cast(\1 as int))", sql)
    return sql.replace("as string)", "as varchar)").replace("\"'s team\"", "'''s team'").replace(" array(", " list_value(")


_LOG = "log AS (SELECT " + ", ".join(f"{_duck(sql)} AS {name}" for name, sql in _FIELDS) + " FROM events)"
_REV = f"rev AS (SELECT {_duck(ev('event_id'))} AS event_id, ts + to_days(1) AS revoked_at FROM events WHERE event_id % 17 = 0)"
_VIS = f"vis AS (SELECT {_duck(ev('event_id'))} AS event_id, CASE WHEN event_id % 10 IN (0, 1) THEN 0 ELSE 1 END AS visibility FROM events WHERE event_id % 13 <> 0)"
_CUR = (
    f"cur AS (SELECT 'cur-' || event_id AS curation_id, {_duck(ev('event_id - (event_id % 70) + 1'))} AS target_id, CAST(CAST(floor(event_id / 7) AS BIGINT) % 4 AS INT) AS kind, "
    "CASE CAST(floor(event_id / 7) AS BIGINT) % 4 WHEN 2 THEN CAST(2.0 AS DOUBLE) WHEN 3 THEN CAST(0.30000001192092896 AS DOUBLE) END AS multiplier, 'amended ' || event_id AS new_content, ts + to_days(2) AS occurred_at, event_id % 5 = 0 AS reverted, 'user-' || user_id AS curator FROM events WHERE event_id % 19 = 0)"
)
_REVIEW = "review AS (SELECT event_id, workstream_id, (['pending', 'approved', 'rejected', 'deferred'])[CAST(b % 4 AS INT) + 1] AS status, created_at AS captured_at, created_at + to_days(CAST(e % 10 AS INT)) AS defer_until, substring(statement, 1, 200) AS summary FROM log WHERE category = 1 AND e % 6 = 0)"
_CORPUS = "corpus AS (SELECT doc_id, 'doc-' || doc_id AS event_id, 'ws-' || (doc_id % 5) AS workstream_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at, text AS content FROM documents)"
_CLOG = "clog AS (SELECT " + ", ".join(f"{_duck(sql)} AS {name}" for name, sql in _CORPUS_FIELDS) + " FROM documents)"
_CREV = "crev AS (SELECT 'doc-' || doc_id AS event_id FROM documents WHERE doc_id % 17 = 0)"
_CVIS = "cvis AS (SELECT 'doc-' || doc_id AS event_id, CASE WHEN doc_id % 10 IN (0, 1) THEN 0 ELSE 1 END AS visibility FROM documents WHERE doc_id % 13 <> 0)"
_ENTRIES = "entries AS (SELECT 'conv-' || conv_id AS session_id, lpad(CAST(turn AS VARCHAR), 6, '0') AS entry_id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id AS INT)) + to_minutes(turn) AS entry_at, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 6 END AS kind, text, conv_id, turn FROM conversations)"
_MARKS = "marks AS (SELECT DISTINCT 'conv-' || conv_id AS session_id, '000001' AS last_entry FROM conversations WHERE conv_id % 2 = 0)"
_ENT = "ent AS (SELECT c_custkey, replace(c_name, '#', '.') || '@' || CASE WHEN c_custkey % 2 = 0 THEN 'gmail.com' ELSE 'example.com' END AS raw FROM customer)"

#: DuckDB common table expressions of the same rows, in order of use.
SQL = {"log": _LOG, "rev": _REV, "vis": _VIS, "cur": _CUR, "review": _REVIEW, "corpus": _CORPUS, "clog": _CLOG, "crev": _CREV, "cvis": _CVIS, "entries": _ENTRIES, "marks": _MARKS, "ent": _ENT}


def ctes(*names: str) -> str:
    """WITH clause that defines the named tables."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
