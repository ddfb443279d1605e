"""One query interface (E1, F23, T7, J16): a request and a token become a scan, a lexical or a hybrid search."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import question_subjects, summary
from . import gates, scans, search
from .maintenance import reranked
from .textindex import TextIndex

#: Candidates that a reranker sees at least.
RERANK_POOL = 150
ITEM = ("event_id", "category", "valid_at", "created_at", "summary", "score")


@dataclass(frozen=True)
class Request:
    text: str | None = None
    workstream: str | None = None
    categories: tuple[int, ...] = ()
    channel: int = 0
    limit: int = 25
    bounds: search.Bounds = search.Bounds()
    explain: bool = False
    supplement: bool = False


@dataclass(frozen=True)
class Sources:
    """What a store offers; without vectors free text is searched lexically, without triples there are no subjects."""

    events: search.Events
    index: TextIndex | None = None
    vectors: DataFrame | None = None
    provider: str = ""
    embed: Callable[[str], DataFrame] | None = None
    triples: DataFrame | None = None
    rerank: Callable[[str, DataFrame], DataFrame] | None = None
    subject_boost: bool = False


@dataclass(frozen=True)
class Result:
    items: DataFrame
    dispatcher: str
    explain: DataFrame | None = None
    triples: DataFrame | None = None
    capability: str = field(default="")


def retrieve_limit(limit: int, reranks: bool) -> int:
    """How many to retrieve before a reranker picks ``limit``."""
    limit = gates.clamp_limit(limit)
    return min(gates.LIMIT_MOST, max(limit, RERANK_POOL)) if reranks else limit


def capability_line(cap: gates.Capability) -> str:
    names = ",".join(str(c) for c in cap.categories)
    return f"viewer={cap.viewer} workstream={cap.workstream or '*'} channel={cap.channel} categories={names}"


def run(sources: Sources, token: gates.Token, request: Request, now: dt.datetime) -> Result:
    """Denied requests raise; free text across workstreams falls back to a scan; with a reranker a wider pool is retrieved first."""
    cap = gates.enforce(token, now, request.workstream, request.categories, request.channel)
    text, clock, events, b = (request.text or "").strip(), now.strftime("%Y-%m-%d %H:%M:%S"), sources.events, request.bounds
    reranks = bool(text) and sources.rerank is not None
    limit = retrieve_limit(request.limit, reranks)
    keys = question_subjects(text) if text else []
    if not text or cap.workstream is None or sources.index is None:
        items = scans.structured_scan(events.log, events.revocations, events.visibility, cap, limit, b.since, b.until, b.as_of, b.principal).withColumn("score", F.lit(1.0))
        name, considered = "structured", None
    elif sources.vectors is not None and sources.embed is not None:
        considered = search.hybrid(sources.index, events, sources.vectors, sources.embed(text), sources.provider, cap, text, clock, limit, b, sources.triples if sources.subject_boost else None, keys)
        items, name = search.top(considered, limit), "hybrid"
    else:
        items, name = search.lexical_search(sources.index, events, cap, text, clock, limit, b), "lexical"
        considered = search.best(sources.index, text, limit, cap.workstream).join(F.broadcast(items.select("event_id", F.lit(True).alias("kept"))), "event_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    if name != "structured":
        items = items.withColumn("summary", summary(F.col("statement"), F.col("skill_name")))
    items = items.select(*ITEM)
    if reranks:
        placed = items.withColumn("place", F.row_number().over(_by_score()))
        items, name = reranked(placed, sources.rerank(text, items), gates.clamp_limit(request.limit)).drop("place"), name + "+rerank"
    line = capability_line(cap)
    counted = (considered if considered is not None else items.withColumn("kept", F.lit(True))) if request.explain else None
    explain = counted.agg(F.lit(name).alias("dispatcher"), F.lit(line).alias("capability"), F.count("*").alias("considered"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("gated")) if counted is not None else None
    more = search.triple_supplement(sources.triples, events, cap, keys, limit, b.principal) if request.supplement and text and cap.workstream and sources.triples is not None else None
    return Result(items, name, explain, more, line)


def _by_score():
    from pyspark.sql import Window as W

    return W.orderBy(F.col("score").desc(), "event_id")  # at most 500 rows
