"""Ingestion (E7, K1, K2, K9, W3): validate, redact, classify, append once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import payloads as P
from ..functions.text import classify, default_visibility

WORKSTREAM = r"^[a-z0-9](?:[a-z0-9]|[-_.](?=[a-z0-9])){0,127}$"


def validated(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with a reason)."""
    reason = F.when(F.coalesce(F.trim("event_id"), F.lit("")) == "", F.lit("no event id")).when(~F.coalesce(F.col("workstream_id").rlike(WORKSTREAM), F.lit(False)), F.lit("not a workstream id"))
    reason = reason.when(~F.coalesce(F.col("channel").isin(0, 1), F.lit(False)), F.lit("not a channel")).when(F.col("payload").isNull(), F.lit("no payload"))
    reason = reason.when(~P.known(P.parsed(F.col("payload"))), F.lit("not a payload"))
    rows = captures.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


@dataclass(frozen=True)
class Seams:
    """What a host may put in place of the built-in redactor, classifier and content shape.

    ``redact`` takes a parsed payload and gives (payload, hits); ``classify`` takes the payload's text,
    whether anything was redacted, and the category; ``shape`` takes the payload's text and category.
    """

    redact: Callable[[Column], Column] = P.redacted
    classify: Callable[[Column, Column, Column], Column] = classify
    shape: Callable[[Column, Column], Column] = lambda text, category: F.lit(0)


def prepared(captures: DataFrame, now: str, seams: Seams = Seams()) -> DataFrame:
    """Log rows: secrets redacted in the payload's text fields, classified by the payload's text, stamped with the store's clock."""
    rows = captures.withColumn("_p", seams.redact(P.parsed(F.col("payload")))).withColumn("payload", F.to_json("_p.payload"))
    text = P.classifier_text(F.col("_p.payload"))
    rows = rows.withColumn("classification", seams.classify(text, F.col("_p.hits") > 0, F.col("category")).cast("int"))
    rows = rows.withColumn("content_shape", seams.shape(text, F.col("category")).cast("int"))
    rows = rows.withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
    null = lambda t: F.lit(None).cast(t)
    return rows.select(
        "event_id", "workstream_id", F.col("channel").alias("event_channel"), "category", "schema_version", F.coalesce("valid_at", "recorded_at", "created_at").alias("valid_at"), null("timestamp_ntz").alias("invalid_at"), "created_at",
        null("timestamp_ntz").alias("expired_at"), "payload", "source", "content_shape", "classification", "principal_id", null("string").alias("artifact_id"),
    )


def new_rows(rows: DataFrame, log: DataFrame) -> DataFrame:
    """The first of each event id that the log does not have."""
    first = F.row_number().over(W.partitionBy("event_id").orderBy("valid_at", "workstream_id", "payload"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n").join(log.select("event_id"), "event_id", "left_anti").select(*rows.columns)


def sidecar_visibility(rows: DataFrame) -> DataFrame:
    """Default visibility of new rows."""
    return rows.select("event_id", default_visibility(F.col("classification")).cast("int").alias("visibility"))


def parked(rows: DataFrame, reviewed_workstreams: list[str]) -> DataFrame:
    """K2: review rows for events of workstreams in review mode."""
    out = rows.where(F.col("workstream_id").isin(*reviewed_workstreams)) if reviewed_workstreams else rows.where(F.lit(False))
    return out.select("event_id", "workstream_id", F.lit("pending").alias("status"), F.col("created_at").alias("captured_at"), F.lit(None).cast("timestamp_ntz").alias("defer_until"), P.summary(P.parsed(F.col("payload"))).alias("summary"))


def revoked(revocations: DataFrame, new: DataFrame, log: DataFrame) -> DataFrame:
    """K9: revocations to append: known events, first stamp wins, none twice."""
    known = new.join(log.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(F.min("revoked_at").alias("revoked_at"))
    return known.join(revocations, "event_id", "left_anti")


def revocation_stamps(new: DataFrame, revocations: DataFrame, log: DataFrame) -> DataFrame:
    """K9: (event_id, revoked_at, first) for each known event of a request: a repeated one gets its original stamp."""
    known = new.join(log.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(F.min("revoked_at").alias("asked"))
    both = known.join(revocations.select("event_id", F.col("revoked_at").alias("had")), "event_id", "left")
    return both.select("event_id", F.coalesce("had", "asked").alias("revoked_at"), F.col("had").isNull().alias("first"))


def tombstones(artifacts: DataFrame, revocations: DataFrame, log: DataFrame) -> DataFrame:
    """K9: artifacts (artifact_id, body, ...) without the bodies of revoked events."""
    gone = log.where("artifact_id is not null").join(revocations.select("event_id"), "event_id", "left_semi").select("artifact_id").distinct().withColumn("_gone", F.lit(True))
    return artifacts.join(gone, "artifact_id", "left").withColumn("body", F.when(F.col("_gone").isNull(), F.col("body"))).drop("_gone")


def outbox(rows: DataFrame) -> DataFrame:
    """A queue row for each new event of the memory channel, for a distiller that runs later."""
    return rows.where(F.col("event_channel") == 0).select("event_id", "workstream_id", F.col("created_at").alias("enqueued_at"))


def is_revoked(revocations: DataFrame, event_id: str) -> bool:
    """S22."""
    return bool(revocations.where(F.col("event_id") == event_id).take(1))


def empty_log(spark) -> DataFrame:
    return spark.createDataFrame([], S.LOG)
