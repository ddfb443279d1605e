"""Session ingestion (F18, W1, W2, W8, J17, A12, R31, X1, E8): the tail after a watermark, chunks, the heuristic distiller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cue, truncated


def tail(entries: DataFrame, watermarks: DataFrame) -> DataFrame:
    """entries after the stored offset of their session, all of a session without one; ids compare as text."""
    rows = entries.join(watermarks, "session_id", "left")
    return rows.where("last_entry is null or entry_id > last_entry").drop("last_entry")


def unseen(tail_: DataFrame, runs: DataFrame) -> DataFrame:
    """Sessions whose (from, to) range has been processed already are skipped."""
    span = tail_.groupBy("session_id").agg(F.min("entry_id").alias("from_entry"), F.max("entry_id").alias("to_entry"))
    new = span.join(runs, ["session_id", "from_entry", "to_entry"], "left_anti").select("session_id")
    return tail_.join(new, "session_id", "left_semi")


def chunks(entries: DataFrame, size: int = 25) -> DataFrame:
    """The chunk number of each entry within its session."""
    n = F.row_number().over(W.partitionBy("session_id").orderBy("entry_id"))
    return entries.withColumn("chunk", F.floor((n - 1) / size).cast("int"))


def advanced(tail_: DataFrame) -> DataFrame:
    """The new watermark of every session with a tail, and the run it records."""
    return tail_.groupBy("session_id").agg(F.max("entry_id").alias("last_entry"), F.min("entry_id").alias("from_entry"), F.max("entry_at").alias("last_at"))


def distilled(entries: DataFrame) -> DataFrame:
    """One row for each entry that is not blank: what it becomes (or that it is dropped), and the statement with its speaker."""
    speaker = F.when(F.coalesce(F.trim("speaker"), F.lit("")) != "", F.col("speaker")) if "speaker" in entries.columns else F.lit(None).cast("string")
    speaker = F.coalesce(speaker, F.when(F.col("kind") == 0, F.lit("User")).otherwise(F.lit("Agent")))
    rows = entries.withColumn("outcome", cue(F.col("text"))).where("outcome is not null")
    statement = F.concat(speaker, F.lit(": "), truncated(F.trim("text", F.lit(" \t\n\r")), 200))
    return rows.select("session_id", "entry_id", "outcome", F.when(F.col("outcome") != "dropped", statement).alias("statement"), "entry_at")


def citation_ranges(events: DataFrame, entries: DataFrame) -> DataFrame:
    """(event_id, first_entry, last_entry, last_at) over the supporting entries of each event."""
    each = events.select("event_id", "session_id", F.explode("supporting").alias("entry_id")).join(entries.select("session_id", "entry_id", "entry_at"), ["session_id", "entry_id"])
    return each.groupBy("event_id").agg(F.min("entry_id").alias("first_entry"), F.max("entry_id").alias("last_entry"), F.max("entry_at").alias("last_at"))


def attach_triples(triples: DataFrame, facts: DataFrame) -> DataFrame:
    """Each triple (chunk, triple_id, support) to the fact (chunk, fact_no, support) of its chunk with most common entries, the first on ties; without common entries the first fact."""
    pairs = triples.join(facts.select("chunk", "fact_no", F.col("support").alias("fact_support")), "chunk")
    overlap = F.size(F.array_intersect("support", "fact_support"))
    best = pairs.groupBy("chunk", "triple_id").agg(F.max(F.struct(overlap.alias("common"), (-F.col("fact_no")).alias("first"))).alias("x"))
    return best.select("chunk", "triple_id", (-F.col("x.first")).alias("fact_no"), F.col("x.common").alias("common"))


def prior_facts(log: DataFrame, revocations: DataFrame, limit: int = 50) -> DataFrame:
    """The newest standing facts of each workstream, for a distiller to build on."""
    place = F.row_number().over(W.partitionBy("workstream_id").orderBy(F.col("valid_at").desc(), "event_id"))
    rows = log.where(F.col("category") == 1).join(revocations.select("event_id"), "event_id", "left_anti")
    return rows.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def distil_run(entries: DataFrame, watermarks: DataFrame, runs: DataFrame, workstreams: DataFrame, now: str, distiller: Callable[[DataFrame], DataFrame] | None = None, distiller_id: str = "cues") -> dict[str, DataFrame]:
    """One run over all sessions with a tail.

    entries: session_id, entry_id, entry_at, kind, text; watermarks: session_id, last_entry; runs:
    session_id, from_entry, to_entry; workstreams: session_id, workstream_id, principal_id. A distiller
    takes the tail and returns (session_id, supporting, category, statement, valid_at or null); without
    one the cues decide. Returns captures for ingestion, the new watermarks and runs, and what was
    dropped. A range that a run has had gives nothing, so a repeated call changes nothing. Event ids come
    from session, place and statement, so that a run that fails half-way makes the same events again.
    """
    rest = unseen(tail(entries, watermarks), runs)
    if distiller is None:
        said = distilled(rest)
        category = F.element_at(F.create_map(*[F.lit(x) for x in ("decision", 2, "goal", 4, "fact", 1, "outcome", 1)]), F.col("outcome"))
        dropped = said.where("outcome = 'dropped'").select("session_id", "entry_id")
        made = said.where("outcome <> 'dropped'").select("session_id", F.array("entry_id").alias("supporting"), category.alias("category"), "statement", F.lit(None).cast("timestamp_ntz").alias("valid_at"))
    else:
        made, dropped = distiller(rest), rest.select("session_id", "entry_id").where(F.lit(False))
    keyed = made.withColumn("event_id", F.concat(F.lit("sess-"), F.substring(F.sha2(F.concat_ws("|", "session_id", F.array_join("supporting", ","), F.col("category").cast("string"), "statement"), 256), 1, 32)))
    ranges = citation_ranges(keyed, rest)
    whole = rest.groupBy("session_id").agg(F.min("entry_id").alias("from_entry"), F.max("entry_id").alias("to_entry"), F.max_by("entry_at", "entry_id").alias("ended"))
    named = F.element_at(F.create_map(*[F.lit(x) for x in (0, "evidence", 1, "fact", 2, "decision", 3, "hypothesis", 4, "goal")]), F.col("category"))
    payload = F.to_json(F.struct(named.alias("$type"), F.col("statement"), F.array().cast("array<string>").alias("supportingEvents")))
    captures = keyed.join(ranges, "event_id", "left").join(whole, "session_id").join(workstreams, "session_id")
    captures = captures.select(
        "event_id", "workstream_id", F.lit(0).alias("channel"), F.col("category").cast("int").alias("category"), F.coalesce("valid_at", "last_at", "ended").alias("valid_at"), F.lit(now).cast("timestamp_ntz").alias("recorded_at"), "principal_id",
        F.lit(f"session/{distiller_id}").alias("source"), payload.alias("payload"), F.lit(1).alias("schema_version"), "session_id", F.coalesce("first_entry", "from_entry").alias("first_entry"), F.coalesce("last_entry", "to_entry").alias("last_entry"),
    )
    count = captures.groupBy("session_id").agg(F.count("*").alias("n_events"))
    ran = whole.select("session_id", "from_entry", "to_entry").join(count, "session_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    marks = whole.select("session_id", F.col("to_entry").alias("last_entry"), F.lit(now).cast("timestamp_ntz").alias("distilled_at"), F.lit(distiller_id).alias("distiller"))
    return {"captures": captures, "watermarks": marks, "runs": ran, "dropped": dropped}
