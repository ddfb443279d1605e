"""Human curation (A7, A8, K10, K11, R16, F16) and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AMEND, ANNOTATE, PIN, DEMOTE, REVERT = range(5)


def standing(curations: DataFrame) -> DataFrame:
    return curations.where(~F.col("reverted"))


def _latest(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("target_id").agg(F.max_by(F.struct(value, "occurred_at"), F.struct("occurred_at", "curation_id")).alias("x"))


def latest_amend(curations: DataFrame) -> DataFrame:
    """The last standing amendment of each target."""
    out = _latest(standing(curations).where(F.col("kind") == AMEND), "new_content")
    return out.select(F.col("target_id").alias("amend_target"), F.col("x.new_content").alias("amended"))


def latest_multiplier(curations: DataFrame) -> DataFrame:
    """The multiplier of the last standing pin or demotion of each target."""
    out = _latest(standing(curations).where(F.col("kind").isin(PIN, DEMOTE)), "multiplier")
    return out.select(F.col("target_id").alias("multiplier_target"), F.col("x.multiplier").alias("latest_multiplier"))


def latest_curation(curations: DataFrame) -> DataFrame:
    """The last standing curation of each target, of any kind."""
    out = standing(curations).groupBy("target_id").agg(F.max_by(F.struct("curation_id", "kind", "occurred_at"), F.struct("occurred_at", "curation_id")).alias("x"))
    return out.select("target_id", "x.*")


def annotation_count(curations: DataFrame) -> DataFrame:
    """Standing annotations of every curated target."""
    return curations.groupBy("target_id").agg(F.count_if((F.col("kind") == ANNOTATE) & ~F.col("reverted")).alias("annotations"))


def pre_state_hash(content: Column, multiplier: Column, annotations: Column) -> Column:
    """Guards a curation against a target that has changed meanwhile."""
    shown = F.when(multiplier == F.floor(multiplier), F.floor(multiplier).cast("string")).otherwise(multiplier.cast("string"))
    return F.upper(F.sha2(F.concat(F.lit("v1|content="), content, F.lit("|mult="), shown, F.lit("|ann="), annotations.cast("string")), 256))


def target_state(log: DataFrame, curations: DataFrame) -> DataFrame:
    """(target_id, hash) of every event that has curations."""
    base = log.join(annotation_count(curations), F.col("event_id") == F.col("target_id")).join(latest_amend(curations), F.col("target_id") == F.col("amend_target"), "left").join(latest_multiplier(curations), F.col("target_id") == F.col("multiplier_target"), "left")
    return base.select("target_id", pre_state_hash(F.coalesce("amended", "statement"), F.coalesce("latest_multiplier", F.lit(1.0)), F.col("annotations")).alias("hash"))


def appended(curations: DataFrame, new: DataFrame, log: DataFrame, workstream: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with a reason): unknown target, out of scope, or a stale hash."""
    known = log.select(F.col("event_id").alias("target_id"), "workstream_id")
    state = target_state(log, curations)
    rows = new.join(known, "target_id", "left").join(state, "target_id", "left")
    reason = F.when(F.col("workstream_id").isNull(), F.lit("unknown target"))
    if workstream:
        reason = reason.when(F.col("workstream_id") != workstream, F.lit("out of scope"))
    reason = reason.when(F.col("expected_hash").isNotNull() & F.col("hash").isNotNull() & (F.col("expected_hash") != F.col("hash")), F.lit("stale"))
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select(*new.columns), rows.where("reason is not null").select(*new.columns, "reason")


def reverted(curations: DataFrame, reverts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(curations afterwards, refused reverts with a reason). reverts: curation_id, curator, occurred_at.

    A revert marks the curation that it names and is a row of its own, of kind REVERT. A second revert of
    one curation, a revert of a revert and one of an unknown curation are refused.
    """
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("curation_id").orderBy("occurred_at", "curator"))
    known = curations.select("curation_id", F.col("kind").alias("_kind"), F.col("reverted").alias("_done"), F.col("target_id").alias("_target"))
    rows = reverts.withColumn("_n", first).join(known, "curation_id", "left")
    reason = F.when(F.col("_kind").isNull(), F.lit("unknown curation")).when(F.col("_kind") == REVERT, F.lit("a revert is not reverted")).when(F.col("_done") | (F.col("_n") > 1), F.lit("already reverted"))
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null")
    marked = curations.join(good.select("curation_id", F.lit(True).alias("_r")), "curation_id", "left").withColumn("reverted", F.col("reverted") | F.coalesce("_r", F.lit(False))).drop("_r")
    own = good.select(F.concat(F.lit("rev-"), F.col("curation_id")).alias("curation_id"), F.col("_target").alias("target_id"), F.lit(REVERT).alias("kind"), "curator", "occurred_at", F.lit(False).alias("reverted"))
    return marked.unionByName(own, allowMissingColumns=True), rows.where("reason is not null").select(*reverts.columns, "reason")


def split_facts(*_args):
    raise NotImplementedError("facts are not split")


def merge_facts(*_args):
    raise NotImplementedError("facts are not merged")


def history(curations: DataFrame, log: DataFrame, workstream: str | None = None, since: str | None = None, principal: str | None = None) -> DataFrame:
    """F16: newest first."""
    rows = curations.join(log.select(F.col("event_id").alias("target_id"), "workstream_id"), "target_id")
    rows = rows.where(F.col("workstream_id") == workstream) if workstream else rows
    rows = rows.where(F.col("occurred_at") >= F.lit(since).cast("timestamp_ntz")) if since else rows
    rows = rows.where(F.col("curator") == principal) if principal else rows
    return rows.orderBy(F.col("occurred_at").desc(), "curation_id")


def review_pending(reviews: DataFrame, now: str) -> DataFrame:
    """Pending, or deferred until now or earlier; oldest first."""
    due = (F.col("status") == "pending") | ((F.col("status") == "deferred") & (F.col("defer_until") <= F.lit(now).cast("timestamp_ntz")))
    return reviews.where(due).orderBy("captured_at", "event_id")


def decided(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviews after decisions (event_id, action, until): only open ones change; approve, reject or defer."""
    new = decisions.select("event_id", F.col("action"), F.col("until"))
    open_ = F.col("status").isin("pending", "deferred") & F.col("action").isNotNull()
    status = F.when(open_, F.element_at(F.create_map(*[F.lit(x) for x in ("approve", "approved", "reject", "rejected", "defer", "deferred")]), F.col("action"))).otherwise(F.col("status"))
    rows = reviews.join(new, "event_id", "left")
    return rows.withColumn("defer_until", F.when(open_ & (F.col("action") == "defer"), F.col("until")).otherwise(F.col("defer_until"))).withColumn("status", status).select(*reviews.columns)


def review_run(reviews: DataFrame, decisions: DataFrame, now: str) -> dict[str, DataFrame]:
    """Decisions (event_id, action, until, reason, principal_id) on reviews, with what follows from them.

    Returns the reviews afterwards; the events to project and index (approved); the revocations to append
    (rejected: their artifacts become tombstones, see ``ingest.tombstones``); an audit event on the
    technical channel for each approval and rejection; and what was refused. Repeating a decision is
    harmless and leaves no second audit event. A rejection needs a reason; what is approved or rejected
    is not deferred.
    """
    rows = decisions.join(reviews.select("event_id", "workstream_id", "status"), "event_id", "left")
    wanted = F.element_at(F.create_map(*[F.lit(x) for x in ("approve", "approved", "reject", "rejected", "defer", "deferred")]), F.col("action"))
    why = F.when(F.col("status").isNull(), F.lit("not in review")).when(wanted.isNull(), F.lit("not an action"))
    why = why.when((F.col("action") == "reject") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), F.lit("a rejection needs a reason"))
    why = why.when((F.col("action") == "defer") & F.col("status").isin("approved", "rejected"), F.lit("already decided"))
    rows = rows.withColumn("refused", why).withColumn("again", wanted == F.col("status"))
    good = rows.where("refused is null and not again")
    after = reviews.join(good.select("event_id", wanted.alias("_s"), "until", F.lit(True).alias("_hit")), "event_id", "left")
    after = after.withColumn("defer_until", F.when(F.col("_hit"), F.when(F.col("_s") == "deferred", F.col("until"))).otherwise(F.col("defer_until")))
    after = after.withColumn("status", F.coalesce("_s", "status")).select(*reviews.columns)
    stamp, acted = F.lit(now).cast("timestamp_ntz"), good.where("action in ('approve', 'reject')")
    audit = acted.select(
        F.concat(F.lit("review-"), F.substring(F.sha2(F.concat_ws("|", "event_id", "action", F.lit(now)), 256), 1, 32)).alias("event_id"), "workstream_id", F.lit(1).alias("event_channel"), F.lit(0).alias("category"),
        F.when(F.col("action") == "approve", F.concat(F.lit("Review approved for event "), F.col("event_id"))).otherwise(F.col("reason")).alias("content"),
        F.when(F.col("action") == "approve", F.lit("event.review_approved")).otherwise(F.lit("event.review_rejected")).alias("source"), "principal_id", stamp.alias("created_at"),
    )
    return {
        "reviews": after, "approved": good.where("action = 'approve'").select("event_id"), "revocations": good.where("action = 'reject'").select("event_id", stamp.alias("revoked_at")),
        "audit": audit, "refused": rows.where("refused is not null").select("event_id", "action", F.col("refused").alias("reason")),
    }
