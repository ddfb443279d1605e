"""Consolidation gates (F19-F22, U6, E11-E13): what may be promoted, how far, and from which sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import gates, projections


def promotion_eligible(outputs: DataFrame, log: DataFrame) -> DataFrame:
    """(output_id, eligible): every source is known and public or internal; no source, not eligible."""
    each = outputs.select("output_id", F.explode_outer("sources").alias("event_id")).join(log.select("event_id", "classification"), "event_id", "left")
    return each.groupBy("output_id").agg(F.bool_and(F.coalesce(F.col("classification").isin(0, 1), F.lit(False))).alias("eligible"))


def capped_visibility(outputs: DataFrame) -> DataFrame:
    """0 unless eligible, at most 2."""
    return outputs.withColumn("visibility", F.when(F.col("eligible"), F.least(F.col("proposed"), F.lit(2))).otherwise(F.lit(0)).cast("int"))


def citation_sources(outputs: DataFrame, log: DataFrame, revocations: DataFrame, visibility: DataFrame, cap: gates.Capability) -> DataFrame:
    """The sources of derived events that the viewer may see: in scope, visible, not revoked."""
    each = outputs.select("output_id", F.explode("sources").alias("event_id"))
    rows = each.join(log, "event_id")
    rows = rows.where(F.col("workstream_id") == cap.workstream) if cap.workstream else rows
    rows = gates.with_visibility(rows, visibility).where(gates.visible(cap.viewer))
    return gates.not_revoked(rows, revocations).select("output_id", "event_id", "category", "statement")


def dream_inputs(log: DataFrame, revocations: DataFrame, visibility: DataFrame, viewer: str, workstream: str, limit: int = 500) -> DataFrame:
    """Newest visible events of a workstream."""
    rows = gates.with_visibility(log.where((F.col("workstream_id") == workstream) & (F.col("event_channel") == 0)), visibility).where(gates.visible(viewer))
    return gates.not_revoked(rows, revocations).orderBy(F.col("created_at").desc(), "event_id").limit(limit)


def visible_events(log: DataFrame, visibility: DataFrame, viewer: str) -> DataFrame:
    """(event_id) of the events that the viewer may see."""
    return gates.with_visibility(log.select("event_id", "principal_id"), visibility).where(gates.visible(viewer)).select("event_id")


def visible_contradictions(contradictions: DataFrame, log: DataFrame, visibility: DataFrame, viewer: str) -> DataFrame:
    """Kept contradictions of which the viewer may see both sides. Both joins move pairs; where pairs are still to be made, ``contradictions_seen`` moves facts only."""
    seen = visible_events(log, visibility, viewer)
    out = contradictions.join(seen.withColumnRenamed("event_id", "event_a"), "event_a", "left_semi")
    return out.join(seen.withColumnRenamed("event_id", "event_b"), "event_b", "left_semi")


def contradictions_seen(triples: DataFrame, log: DataFrame, visibility: DataFrame, viewer: str) -> DataFrame:
    """J12 from triples: what the viewer may not see goes before facts meet, so pairs are made once and stay where they are."""
    return projections.contradictions(triples.join(visible_events(log, visibility, viewer), "event_id", "left_semi"))


def pooled_skills(skills: DataFrame, revocations: DataFrame, visibility: DataFrame, workstreams: list[str], global_workstream: str = "global", each: int = 200) -> DataFrame:
    """Shared skills of the workstreams that opted in, the newest ``each`` of every one."""
    rows = skills.where(F.col("workstream_id").isin(*workstreams) & (F.col("workstream_id") != global_workstream)).drop("revoked_at")
    rows = gates.not_revoked(rows.join(visibility, "event_id", "left").where("coalesce(visibility, 1) >= 1"), revocations)
    place = F.row_number().over(W.partitionBy("workstream_id").orderBy(F.col("valid_at").desc(), "event_id"))
    return rows.withColumn("place", place).where(F.col("place") <= each).drop("place", "visibility")


def consolidate(inputs: DataFrame, dreamer, schema: str, log: DataFrame, keep_ineligible: bool = True) -> DataFrame:
    """A dreamer (pandas function per workstream) proposes outputs; their visibility is capped, and with the floor ineligible ones drop."""
    outputs = inputs.groupBy("workstream_id").applyInPandas(dreamer, schema)
    judged = outputs.join(promotion_eligible(outputs, log), "output_id", "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    return capped_visibility(judged if keep_ineligible else judged.where("eligible"))


def dream_run(events: DataFrame, dreamer, schema: str, log: DataFrame, now: str, kind: str = "dream", floor: bool = False) -> dict[str, DataFrame]:
    """A dreamer's outputs as captures with capped visibility, and an audit row of the run for each workstream.

    The dreamer's schema holds output_id, workstream_id, category, statement, sources, proposed. With a
    ``floor`` (a fleet's run) ineligible outputs are dropped. Event ids come from the content, so a run
    that is repeated after a failure makes the same events.
    """
    from ..functions.text import content_id

    out = consolidate(events, dreamer, schema, log, keep_ineligible=not floor)
    number = content_id(f"{kind}-", F.col("workstream_id"), F.col("category"), F.col("statement"), F.array_join("sources", ","))
    name = F.element_at(F.array(*[F.lit(n) for n in ("evidence", "fact", "decision", "hypothesis", "goal", "action", "outcome")]), F.col("category") + 1)
    payload = F.to_json(F.struct(name.alias("$type"), F.col("statement"), F.col("sources").alias("supportingEvents")))
    made = out.withColumn("event_id", number).dropDuplicates(["event_id"])
    captures = made.select("event_id", "workstream_id", F.lit(0).alias("channel"), "category", F.lit(now).cast("timestamp_ntz").alias("valid_at"), F.lit(now).cast("timestamp_ntz").alias("recorded_at"), F.lit(None).cast("string").alias("principal_id"), F.lit(f"{kind}/run").alias("source"), payload.alias("payload"), F.lit(1).alias("schema_version"))
    seen = events.groupBy("workstream_id").agg(F.count("*").alias("n_inputs"))
    audit = seen.join(made.groupBy("workstream_id").agg(F.count("*").alias("n_outputs"), F.count_if("eligible").alias("n_eligible")), "workstream_id", "left").na.fill(0, ["n_outputs", "n_eligible"])
    audit = audit.select(content_id("run-", F.col("workstream_id"), F.lit(kind), F.lit(now)).alias("run_id"), "workstream_id", F.lit(kind).alias("kind"), F.lit(now).cast("timestamp_ntz").alias("ran_at"), "n_inputs", "n_outputs", "n_eligible")
    return {"captures": captures, "visibility": made.select("event_id", "visibility"), "audit": audit}


#: Pooled skills that a dreamer sees at once.
FLEET_PART = 5000


def fleet_run(token: gates.Token, config: DataFrame, skills: DataFrame, revocations: DataFrame, visibility: DataFrame, log: DataFrame, dreamer, schema: str, now: str, dreamer_id: str = "fleet", global_workstream: str = "global", each: int = 200) -> dict[str, DataFrame]:
    """Skills of all workstreams that opted in, pooled, consolidated into the global workstream behind the classification floor.

    Needs a token that spans workstreams and names none. config: workstream_id, opted_in. The newest
    ``each`` skills of a workstream take part, revoked and unshared ones do not. The dreamer gets the pool
    in parts of about ``FLEET_PART`` by the skill's name, so equal names meet and no task holds the
    fleet. Outputs without sources or with one that is not public or internal are dropped and counted as
    skipped; the rest is visible to all. Returns captures, visibility and a one-row summary.
    """
    from ..functions.text import content_id

    if not (token.cross and token.workstream is None):
        raise gates.Denied("a fleet's run needs a token that spans workstreams")
    taking = config.where(F.col("opted_in") & (F.col("workstream_id") != global_workstream)).select("workstream_id").distinct()
    pool = gates.not_revoked(skills.drop("revoked_at").join(taking, "workstream_id", "left_semi").join(visibility, "event_id", "left").where("coalesce(visibility, 1) >= 1").drop("visibility"), revocations)
    place = F.row_number().over(W.partitionBy("workstream_id").orderBy(F.col("valid_at").desc(), "event_id"))
    pool = pool.withColumn("place", place).where(F.col("place") <= each).drop("place")
    parts = max(1, -(-pool.count() // FLEET_PART))
    inputs = pool.withColumn("workstream_id", F.lit(global_workstream)).withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)))
    outputs = inputs.groupBy("part").applyInPandas(dreamer, schema)
    judged = outputs.join(promotion_eligible(outputs, log), "output_id", "left").withColumn("ok", F.coalesce("eligible", F.lit(False)))
    named = F.element_at(F.array(*[F.lit(n) for n in ("evidence", "fact", "decision", "hypothesis", "goal", "action", "outcome")]), F.col("category") + 1)
    made = judged.where("ok").withColumn("event_id", content_id("fleet-", F.col("category"), F.col("statement"), F.array_join("sources", ","))).dropDuplicates(["event_id"])
    payload = F.to_json(F.struct(named.alias("$type"), F.col("statement"), F.col("sources").alias("supportingEvents")))
    clock = F.lit(now).cast("timestamp_ntz")
    captures = made.select("event_id", F.lit(global_workstream).alias("workstream_id"), F.lit(0).alias("channel"), "category", clock.alias("valid_at"), clock.alias("recorded_at"), F.lit(token.principal).alias("principal_id"), F.lit(f"fleet/{dreamer_id}").alias("source"), payload.alias("payload"), F.lit(1).alias("schema_version"))
    one = lambda t, c, e: t.agg(e.alias(c))
    summary = one(taking, "participating", F.count("*")).crossJoin(one(pool, "n_inputs", F.count("*"))).crossJoin(one(made, "n_outputs", F.count("*"))).crossJoin(one(judged, "n_skipped", F.count_if(~F.col("ok"))))  # one row each
    summary = summary.select(content_id("fleet-run-", F.lit(dreamer_id), F.lit(now)).alias("run_id"), F.lit(dreamer_id).alias("dreamer"), clock.alias("ran_at"), "*")
    return {"captures": captures, "visibility": made.select("event_id", F.lit(2).alias("visibility")), "summary": summary}


def dream_skills(skills: DataFrame, revocations: DataFrame, visibility: DataFrame, log: DataFrame, viewer: str, workstream: str, limit: int = 100) -> DataFrame:
    """The newest standing skills of a workstream that the viewer may see."""
    rows = gates.not_revoked(skills.where(F.col("workstream_id") == workstream), revocations).join(log.select("event_id", "principal_id"), "event_id")
    return gates.with_visibility(rows, visibility).where(gates.visible(viewer)).orderBy(F.col("valid_at").desc(), "event_id").limit(limit)


def newest_contradictions(found: DataFrame, limit: int = 100) -> DataFrame:
    """T9."""
    return found.orderBy(F.col("detected_at").desc(), "event_a", "event_b").limit(limit)


def judged(rows: DataFrame, judge, schema: str) -> DataFrame:
    """A host's judge or extractor (pandas function over Arrow batches) on rows."""
    return rows.mapInPandas(lambda batches: (judge(b) for b in batches), schema)
