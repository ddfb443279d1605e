"""Capabilities and gates (F1-F10): who may see which events, and when."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORKSTREAM_ID = re.compile(r"^[a-z0-9](?:[a-z0-9]|[-_.](?=[a-z0-9])){0,127}$")
LIMIT_MOST = 500


class Denied(PermissionError):
    """A request that its token does not allow."""


@dataclass(frozen=True)
class Token:
    principal: str
    workstream: str | None = None
    not_before: dt.datetime = dt.datetime(2024, 1, 1)
    not_after: dt.datetime = dt.datetime(2025, 1, 1)
    categories: tuple[int, ...] = tuple(range(7))
    cross: bool = False
    technical: bool = False


@dataclass(frozen=True)
class Capability:
    viewer: str
    workstream: str | None
    categories: tuple[int, ...]
    channel: int
    cross: bool


def workstream_id(value: str) -> str:
    if not WORKSTREAM_ID.match(value or ""):
        raise ValueError(f"not a workstream id: {value!r}")
    return value


def enforce(token: Token, now: dt.datetime, workstream: str | None = None, categories: tuple[int, ...] = (), channel: int = 0) -> Capability:
    """the effective scope of a request; denials in order: validity window, workstream, channel, categories."""
    if not token.not_before <= now < token.not_after:
        raise Denied("the token is not valid now")
    if token.workstream is not None and workstream is not None and workstream != token.workstream:
        raise Denied("the token is for another workstream")
    scope = workstream or token.workstream
    if scope is None and not token.cross:
        raise Denied("the token does not span workstreams")
    if channel == 1 and not token.technical:
        raise Denied("the token does not include the technical channel")
    effective = tuple(c for c in token.categories if not categories or c in categories)
    if not effective:
        raise Denied("no category is allowed")
    return Capability(token.principal, workstream_id(scope) if scope else None, effective, channel, scope is None)


def clamp_limit(limit: int) -> int:
    return max(1, min(LIMIT_MOST, limit))


def visible(viewer: str) -> Column:
    """shared, or the viewer's own; a null visibility is shared, a null principal nobody's."""
    return (F.coalesce(F.col("visibility"), F.lit(1)) >= 1) | F.coalesce(F.col("principal_id") == viewer, F.lit(False))


def as_of(when: str) -> Column:
    """known by then and not yet invalid."""
    t = F.lit(when).cast("timestamp_ntz")
    return (F.col("created_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t))


def scope(cap: Capability) -> Column:
    """F2, F7 and the workstream of a capability."""
    out = (F.col("event_channel") == cap.channel) & F.col("category").isin(*cap.categories)
    return out & (F.col("workstream_id") == cap.workstream) if cap.workstream else out


def valid_between(since: str | None = None, until: str | None = None) -> Column:
    """inclusive at both ends, open where null."""
    out = F.lit(True)
    if since:
        out = out & (F.col("valid_at") >= F.lit(since).cast("timestamp_ntz"))
    return out & (F.col("valid_at") <= F.lit(until).cast("timestamp_ntz")) if until else out


def with_visibility(log: DataFrame, visibility: DataFrame) -> DataFrame:
    return log.join(visibility, "event_id", "left")


def with_revocations(log: DataFrame, revocations: DataFrame) -> DataFrame:
    return log.join(revocations, "event_id", "left")


def not_revoked(log: DataFrame, revocations: DataFrame) -> DataFrame:
    """J2."""
    return log.join(revocations, "event_id", "left_anti")


def hydrate(log: DataFrame, revocations: DataFrame, visibility: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows of candidate ids with both sidecars; ids never leave the cluster."""
    return with_visibility(with_revocations(log.join(candidates, "event_id", "left_semi"), revocations), visibility)
