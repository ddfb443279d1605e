"""Lexical, semantic and hybrid retrieval behind the gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as R
from ..functions.text import subject_key
from . import gates
from .textindex import TextIndex, best


@dataclass(frozen=True)
class Bounds:
    """What a request asks for besides its text."""

    since: str | None = None
    until: str | None = None
    as_of: str | None = None
    principal: str | None = None


@dataclass(frozen=True)
class Events:
    """The log with its sidecars."""

    log: DataFrame
    revocations: DataFrame
    visibility: DataFrame


def gate(cap: gates.Capability, bounds: Bounds) -> Column:
    """F2-F7 of a log row with its visibility; revocation is a join of its own."""
    out = gates.scope(cap) & gates.valid_between(bounds.since, bounds.until) & gates.visible(cap.viewer)
    out = out & gates.as_of(bounds.as_of) if bounds.as_of else out
    return out & (F.col("principal_id") == bounds.principal) if bounds.principal else out


def passed(candidates: DataFrame, events: Events, cap: gates.Capability, bounds: Bounds) -> DataFrame:
    """Candidates (event_id, ...; at most a few hundred rows) whose events pass every gate, with the log's columns.

    The candidates' ids go to the log and its sidecars, never the other way round.
    """
    ids = F.broadcast(candidates.select("event_id"))
    only = lambda t: t.join(ids, "event_id", "left_semi")
    rows = only(events.log).join(F.broadcast(only(events.visibility)), "event_id", "left").where(gate(cap, bounds))
    rows = rows.join(F.broadcast(only(events.revocations).select("event_id")), "event_id", "left_anti")
    return F.broadcast(candidates).join(rows.drop("created_at") if "created_at" in candidates.columns else rows, "event_id")


def lexical_search(index: TextIndex, events: Events, cap: gates.Capability, query: str, now: str, limit: int = 25, bounds: Bounds = Bounds()) -> DataFrame:
    """The workstream's best raw scores, then every gate, then by normalised score times recency.

    The limit comes before the gates, so fewer rows may return.
    """
    found = best(index, query, gates.clamp_limit(limit), cap.workstream)
    found = found.withColumn("recency", R.recency(F.col("created_at"), now)).withColumn("score", F.col("bm25") * F.col("recency")).drop("workstream_id")
    return passed(found, events, cap, bounds).orderBy(F.col("score").desc(), "event_id")


def vector_topk(vectors: DataFrame, query: DataFrame, limit: int, key: str = "vec_id", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, cosine, and ``more``) of the nearest vectors; query: one row with q."""
    scored = vectors.crossJoin(F.broadcast(query.limit(1))).select(key, R.cosine(F.col("embedding"), F.col("q")).alias("cosine"), *more)
    return scored.orderBy(F.col("cosine").desc(), key).limit(limit)


def live_vectors(vectors: DataFrame, events: Events, workstream: str, provider: str) -> DataFrame:
    """Vectors (event_id, provider_id, embedding) of one provider whose events are of the workstream and not revoked."""
    live = gates.not_revoked(events.log.where(F.col("workstream_id") == workstream), events.revocations).select("event_id", "created_at")
    return vectors.where(F.col("provider_id") == provider).join(live, "event_id")


def at_hand(rows: DataFrame) -> DataFrame:
    """A few hundred rows that a limit bounds, computed once however often the plan goes on from them."""
    return rows.sparkSession.createDataFrame([tuple(r) for r in rows.collect()], rows.schema).coalesce(1)


def pool(limit: int) -> int:
    return min(200, max(8 * limit, 64))


def injected(limit: int) -> int:
    """Most events that only their subject brings in."""
    return max(6, limit // 3)


def hybrid(index: TextIndex, events: Events, vectors: DataFrame, query_vector: DataFrame, provider: str, cap: gates.Capability, query: str, now: str, limit: int = 10, bounds: Bounds = Bounds(), triples: DataFrame | None = None, keys: list[str] = ()) -> DataFrame:
    """The pools of both sides meet by full outer join (J14), subjects add a boost, all pass the gates, by fused score times recency.

    ``keys`` are the subject keys of the question: events with such a triple (J7) are boosted, and those
    that neither pool holds come in up to a cap (T6), in order of their ids. Recency is the semantic
    side's, else the lexical side's, else 1. Returns every candidate with its parts, ``allowed`` by the
    gates and ``kept``, which needs the fused score's gate (F10), too.
    """
    sem = vector_topk(live_vectors(vectors, events, cap.workstream, provider), query_vector, pool(limit), "event_id", ("created_at",))
    sem = sem.select("event_id", F.col("cosine").alias("semantic"), R.recency(F.col("created_at"), now).alias("rs"))
    lex = best(index, query, pool(limit), cap.workstream).select("event_id", F.col("bm25").alias("lexical"), R.recency(F.col("created_at"), now).alias("rl"))
    both = at_hand(sem.join(lex, "event_id", "full_outer").withColumn("subject", F.lit(0.0)))
    if triples is not None and any(keys):
        about = subject_match(triples.where(F.col("workstream_id") == cap.workstream), list(keys)).select("event_id").distinct()
        hit = about.withColumn("hit", F.lit(1.0))
        both = both.join(hit.join(F.broadcast(both.select("event_id")), "event_id", "left_semi"), "event_id", "left").withColumn("subject", F.coalesce("hit", F.lit(0.0))).drop("hit")
        new = about.join(F.broadcast(both.select("event_id")), "event_id", "left_anti").orderBy("event_id").limit(injected(limit))
        both = at_hand(both.unionByName(new.withColumn("subject", F.lit(1.0)), allowMissingColumns=True))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = both.select("event_id", zero("semantic").alias("semantic"), zero("lexical").alias("lexical"), "subject", F.coalesce("rs", "rl", F.lit(1.0)).alias("recency"))
    both = both.withColumn("fused", R.SEMANTIC * F.col("semantic") + R.LEXICAL * F.col("lexical") + R.SUBJECT * F.col("subject")).withColumn("score", F.col("fused") * F.col("recency"))
    right = passed(both.select("event_id"), events, cap, bounds).withColumn("allowed", F.lit(True))
    both = both.join(F.broadcast(right), "event_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
    return both.withColumn("kept", F.col("allowed") & (F.col("fused") >= R.GATE))


def explained(candidates: DataFrame, events: Events, cap: gates.Capability, bounds: Bounds = Bounds()) -> DataFrame:
    """the candidates of ``hybrid`` with gate_reason: the first gate that holds an item back, null where it is kept."""
    candidates = candidates.select("event_id", "semantic", "lexical", "subject", "fused", "recency", "score", "kept")
    ids = F.broadcast(candidates.select("event_id"))
    only = lambda t: t.join(ids, "event_id", "left_semi")
    rows = only(events.log).select("event_id", "workstream_id", "event_channel", "category", "valid_at", "invalid_at", F.col("created_at").alias("logged_at"), "principal_id")
    rows = rows.join(F.broadcast(only(events.visibility)), "event_id", "left").join(F.broadcast(only(events.revocations).select("event_id", F.lit(True).alias("_gone"))), "event_id", "left").withColumn("_known", F.lit(True))
    both = candidates.join(F.broadcast(rows), "event_id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    tests = [("not in the log", F.col("_known"))]
    tests += [("workstream", F.col("workstream_id") == cap.workstream)] if cap.workstream else []
    tests += [("channel", F.col("event_channel") == cap.channel), ("category", F.col("category").isin(*cap.categories)), ("valid time", gates.valid_between(bounds.since, bounds.until))]
    if bounds.as_of:
        at = F.lit(bounds.as_of).cast("timestamp_ntz")
        tests.append(("as of", (F.col("logged_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at))))
    tests += [("principal", F.col("principal_id") == bounds.principal)] if bounds.principal else []
    tests += [("visibility", gates.visible(cap.viewer)), ("revoked", F.col("_gone").isNull()), ("score", F.col("fused") >= R.GATE)]
    reason = F.coalesce(*[F.when(no(ok), F.lit(name)) for name, ok in tests])
    return both.select(*candidates.columns, reason.alias("gate_reason"))


def top(candidates: DataFrame, limit: int) -> DataFrame:
    return candidates.where("kept").orderBy(F.col("score").desc(), "event_id").limit(limit)


def subject_match(triples: DataFrame, keys: list[str]) -> DataFrame:
    """Triples whose subject key contains one of the query's few keys, or lies in one."""
    wanted = [k for k in keys if k]
    if not wanted:
        return triples.where(F.lit(False))
    column, hit = F.col("subject_key"), F.lit(False)
    for k in wanted:
        hit = hit | F.contains(column, F.lit(k)) | F.contains(F.lit(k), column)
    return triples.where(hit)


def triple_supplement(triples: DataFrame, events: Events, cap: gates.Capability, keys: list[str], limit: int, principal: str | None = None) -> DataFrame:
    """Newest matching triples of the capability's categories and channel that the viewer may see, each (subject, predicate, object) once, at most max(6, limit / 3)."""
    found = subject_match(triples, list(keys)).drop("workstream_id")
    rows = events.log.select("event_id", "workstream_id", "principal_id", "category", "event_channel").where(gates.scope(cap))
    rows = rows.where(F.col("principal_id") == principal) if principal else rows
    found = found.join(rows, "event_id").join(events.visibility, "event_id", "left").where(gates.visible(cap.viewer))
    found = gates.not_revoked(found, events.revocations)
    newest = F.max_by(F.struct("event_id", "valid_at"), F.struct(F.col("valid_at"), F.col("event_id")))
    once = found.groupBy("subject_key", "predicate", "object").agg(newest.alias("x")).select("subject_key", "predicate", "object", "x.event_id", "x.valid_at")
    return once.orderBy(F.col("valid_at").desc(), F.col("event_id").desc()).limit(max(6, limit // 3))


__all__ = ["Bounds", "Events", "hybrid", "lexical_search", "passed", "subject_key", "subject_match", "top", "triple_supplement", "vector_topk"]
