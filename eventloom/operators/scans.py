"""Structured scans (E2, E5, S1, S2, S9): filters go to the scan, the sidecars join as late as their meaning allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import summary
from . import gates

ITEM = ("event_id", "workstream_id", "category", "principal_id", "valid_at", "created_at", "summary")


def structured_scan(log: DataFrame, revocations: DataFrame, visibility: DataFrame, cap: gates.Capability, limit: int = 25, since: str | None = None, until: str | None = None, as_of: str | None = None, principal: str | None = None, filter_first: bool = False) -> DataFrame:
    """Newest valid first. Revoked rows go after the limit, so fewer may return; ``filter_first`` drops them before it."""
    rows = log.where(gates.scope(cap) & gates.valid_between(since, until))
    rows = rows.where(gates.as_of(as_of)) if as_of else rows
    rows = rows.where(F.col("principal_id") == principal) if principal else rows
    rows = gates.with_visibility(rows, visibility).where(gates.visible(cap.viewer))
    rows = gates.not_revoked(rows, revocations) if filter_first else rows
    rows = rows.orderBy(F.col("valid_at").desc(), "event_id").limit(gates.clamp_limit(limit))
    rows = rows if filter_first else gates.not_revoked(rows, revocations)
    return rows.withColumn("summary", summary(F.col("statement"), F.col("skill_name"))).select(*ITEM)


def list_recent(log: DataFrame, revocations: DataFrame, visibility: DataFrame, cap: gates.Capability, limit: int = 25) -> DataFrame:
    """E5: newest known first, memory channel only; revoked rows go after the limit."""
    cap = gates.Capability(cap.viewer, cap.workstream, cap.categories, 0, cap.cross)
    rows = gates.with_visibility(log.where(gates.scope(cap)), visibility).where(gates.visible(cap.viewer))
    rows = rows.orderBy(F.col("created_at").desc(), "event_id").limit(gates.clamp_limit(limit))
    return gates.not_revoked(rows, revocations).withColumn("summary", summary(F.col("statement"), F.col("skill_name"))).select(*ITEM)


def read_all(log: DataFrame, revocations: DataFrame, category: int | None = None) -> DataFrame:
    """The log with its revocation stamps, in no order."""
    rows = log if category is None else log.where(F.col("category") == category)
    return gates.with_revocations(rows, revocations)


def read_one(log: DataFrame, event_id: str) -> DataFrame:
    return log.where(F.col("event_id") == event_id)


def latest(log: DataFrame) -> DataFrame:
    """The last known event of each workstream; ties go to the larger id."""
    last = F.max(F.struct("created_at", "event_id"))
    return log.groupBy("workstream_id").agg(last.alias("x")).select("workstream_id", F.col("x.event_id").alias("event_id"), F.col("x.created_at").alias("created_at"))
