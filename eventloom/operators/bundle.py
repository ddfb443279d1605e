"""Budgeted context bundles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scoring as R
from ..functions.text import keyword, token_estimate, truncated


#: Best first: by score, then newest, then id.
_ORDER = ("-score", "-unix_micros(cast(valid_at as timestamp))", "event_id")
#: Fewest tokens of a line: "- x [y]" has seven characters.
LEAST = 2


def category_rank(category: Column) -> Column:
    """A13."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, S.BUNDLE_ORDER)), category), F.lit(100)).cast("int") - 1


def scored_events(log: DataFrame, revocations: DataFrame, curations: DataFrame, now: str, viewer: str | None = None, visibility: DataFrame | None = None) -> DataFrame:
    """Memory-channel events that are not revoked, with amendments and multipliers applied and a bundle score.

    With ``viewer`` the visibility gate holds too; without, every author's events count, as in the plain form.
    """
    from .curation import latest_amend, latest_multiplier
    from .gates import not_revoked, visible

    rows = not_revoked(log.where(F.col("event_channel") == 0), revocations)
    if viewer is not None:
        rows = rows.join(visibility, "event_id", "left").where(visible(viewer))
    rows = rows.join(latest_amend(curations), F.col("event_id") == F.col("amend_target"), "left").join(latest_multiplier(curations), F.col("event_id") == F.col("multiplier_target"), "left")
    fresh = F.exp(-F.greatest(F.lit(0.0), R.age_days(F.col("created_at"), now)) / R.RECENCY_DAYS)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), fresh * F.coalesce("latest_multiplier", F.lit(1.0))))
    text = F.when(F.col("skill_name").isNotNull(), F.concat_ws(" — ", "skill_name", "statement")).otherwise(F.coalesce("amended", "statement"))
    return rows.select("workstream_id", "event_id", "category", "valid_at", text.alias("text"), F.round(score, 9).alias("score"))


def packed(events: DataFrame, budget: int = 4096) -> DataFrame:
    """Per workstream and category the lines that fit, best score first; a line that would overflow becomes a hint and packing goes on.

    Of lines that cost c tokens only the first budget / c of a group can ever fit, so the fold, which must
    go in order, sees a number of lines that the budget bounds; all others overflow.
    """
    from pyspark.sql import Window as W

    each = section_budget(budget)
    line = F.concat(F.lit("- "), truncated(F.col("text"), 200), F.lit(" ["), F.col("event_id"), F.lit("]"))
    rows = events.withColumn("tokens", token_estimate(line))
    alike = W.partitionBy("workstream_id", "category", "tokens").orderBy(*map(F.expr, _ORDER))
    # no line costs fewer than LEAST tokens, so a constant bound cuts the ranking before its exchange
    first = rows.withColumn("n", F.row_number().over(alike)).where((F.col("n") <= max(1, each // LEAST)) & (F.col("n") * F.col("tokens") <= each))
    order = F.struct((-F.col("score")).alias("s"), (-F.unix_micros(F.col("valid_at").cast("timestamp"))).alias("v"), "event_id", "tokens")
    groups = first.groupBy("workstream_id", "category").agg(F.array_sort(F.collect_list(order)).alias("x"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        fits = acc["used"] + x["tokens"] <= each
        return F.struct((acc["used"] + F.when(fits, x["tokens"]).otherwise(F.lit(0))).alias("used"), F.when(fits, F.concat(acc["out"], F.array(x["event_id"]))).otherwise(acc["out"]).alias("out"))

    fitting = groups.select(F.explode(F.aggregate("x", start, step)["out"]).alias("event_id"), F.lit(True).alias("fits"))
    return rows.join(fitting, "event_id", "left").withColumn("fits", F.coalesce("fits", F.lit(False)))


def section_budget(budget: int) -> int:
    return 800 if budget <= 0 else max(200, budget // 8)


def hint_budget(budget: int) -> int:
    return 200 if budget <= 0 else max(50, budget // 16)


def sections(events: DataFrame, budget: int = 4096) -> DataFrame:
    """Per workstream and category: lines, tokens and the events they come from."""
    out = packed(events, budget).groupBy("workstream_id", "category").agg(F.count_if("fits").alias("n_lines"), F.sum(F.when(F.col("fits"), F.col("tokens")).otherwise(0)).cast("long").alias("tokens"), F.count("*").alias("n_events"))
    return out.where("n_lines > 0").withColumn("rank", category_rank(F.col("category")))


def hints(events: DataFrame, budget: int = 4096) -> DataFrame:
    """Overflowing lines in section order as hints, up to the first that breaks the hint budget.

    Every hint costs a token at least, so only the first lines of a workstream, as many as the budget, are ranked.
    """
    from pyspark.sql import Window as W

    most = hint_budget(budget)
    over = packed(events, budget).where("not fits").withColumn("rank", category_rank(F.col("category")))
    over = over.withColumn("n", F.row_number().over(W.partitionBy("workstream_id").orderBy("rank", *map(F.expr, _ORDER)))).where(F.col("n") <= most)
    over = over.withColumn("keyword", keyword(F.col("text"))).withColumn("context", truncated(F.col("text"), 80))
    cost = token_estimate(F.col("keyword")) + token_estimate(F.col("context"))
    over = over.withColumn("cost", F.greatest(cost, F.lit(0))).withColumn("running", F.sum("cost").over(W.partitionBy("workstream_id").orderBy("n")))
    return over.where(F.col("running") <= most).select("workstream_id", "event_id", "category", "keyword", "context", F.col("running").cast("long").alias("running"))


def orientation(n_events: Column, n_sections: Column) -> Column:
    """The opening paragraph of a bundle that no distiller has written."""
    return F.concat(F.lit("A plain list of "), n_events.cast("string"), F.lit(" events in "), n_sections.cast("string"), F.lit(" categories, best first; nothing has been summarised."))


def totals(events: DataFrame, budget: int = 4096) -> DataFrame:
    """Per workstream the tokens of sections, orientation and hints together."""
    s = sections(events, budget).groupBy("workstream_id").agg(F.count("*").alias("n_sections"), F.sum("n_events").alias("n_events"), F.sum("tokens").alias("section_tokens"))
    h = hints(events, budget).groupBy("workstream_id").agg(F.count("*").alias("n_hints"), F.max("running").alias("hint_tokens"))
    both = s.join(h, "workstream_id", "left").withColumn("n_hints", F.coalesce("n_hints", F.lit(0))).withColumn("hint_tokens", F.coalesce("hint_tokens", F.lit(0)))
    words = token_estimate(orientation(F.col("n_events"), F.col("n_sections"))).cast("long")
    return both.select("workstream_id", "n_sections", "n_hints", (F.col("section_tokens") + F.col("hint_tokens") + words).alias("token_count"))


#: A bundle as it is cached: one row for each workstream.
BUNDLE = "workstream_id string, orientation string, sections array<struct<category:int,tokens:bigint,lines:array<string>,provenance:array<string>>>, hints array<struct<keyword:string,event_id:string,context:string>>, token_count bigint, covered_through string, generated_at timestamp_ntz, distiller string"


def assembled(events: DataFrame, log: DataFrame, now: str, budget: int = 4096) -> DataFrame:
    """A bundle for each workstream that has events; its lines and hints are bounded by the budget."""
    from .scans import latest

    line = F.concat(F.lit("- "), truncated(F.col("text"), 200), F.lit(" ["), F.col("event_id"), F.lit("]"))
    kept = packed(events, budget).where("fits").withColumn("line", line).withColumn("rank", category_rank(F.col("category")))
    item = F.struct((-F.col("score")).alias("s"), (-F.unix_micros(F.col("valid_at").cast("timestamp"))).alias("v"), "event_id", "line")
    by = kept.groupBy("workstream_id", "category", "rank").agg(F.sum("tokens").cast("long").alias("tokens"), F.array_sort(F.collect_list(item)).alias("x"))
    section = F.struct("rank", "category", "tokens", F.col("x.line").alias("lines"), F.col("x.event_id").alias("provenance"))
    by = by.groupBy("workstream_id").agg(F.array_sort(F.collect_list(section)).alias("x"))
    by = by.select("workstream_id", F.transform("x", lambda v: F.struct(v["category"].alias("category"), v["tokens"].alias("tokens"), v["lines"].alias("lines"), v["provenance"].alias("provenance"))).alias("sections"))
    told = hints(events, budget).groupBy("workstream_id").agg(F.array_sort(F.collect_list(F.struct("running", "keyword", "event_id", "context"))).alias("x"))
    told = told.select("workstream_id", F.transform("x", lambda v: F.struct(v["keyword"].alias("keyword"), v["event_id"].alias("event_id"), v["context"].alias("context"))).alias("hints"))
    numbers = events.groupBy("workstream_id").agg(F.count("*").alias("n_events"))
    out = by.join(told, "workstream_id", "left").join(totals(events, budget).select("workstream_id", "token_count", "n_sections"), "workstream_id").join(numbers, "workstream_id")
    out = out.join(latest(log).select("workstream_id", F.col("event_id").alias("covered_through")), "workstream_id")
    out = out.withColumn("hints", F.coalesce("hints", F.array().cast("array<struct<keyword:string,event_id:string,context:string>>")))
    return out.select("workstream_id", orientation(F.col("n_events"), F.col("n_sections")).alias("orientation"), "sections", "hints", "token_count", "covered_through", F.lit(now).cast("timestamp_ntz").alias("generated_at"), F.lit("plain").alias("distiller"))


def served(cached: DataFrame, events: DataFrame, log: DataFrame, curations: DataFrame, now: str, budget: int = 4096, refresh: bool = False, distiller: Callable[[DataFrame], DataFrame] | None = None, distiller_id: str = "plain") -> tuple[DataFrame, DataFrame]:
    """(bundles to hand out, the cache afterwards).

    A cached bundle is handed out while it is fresh (W6); the others are made anew, by a host's distiller
    over the workstream's scored events or plainly, and replace the cached ones.
    """
    from .maintenance import upserted

    state = stale(cached, log, curations)
    fresh = cached.join(state.where("not stale").select("workstream_id"), "workstream_id", "left_semi") if not refresh else cached.where(F.lit(False))
    due = events.join(fresh.select("workstream_id"), "workstream_id", "left_anti")
    made = distiller(due).withColumn("distiller", F.lit(distiller_id)) if distiller else assembled(due, log, now, budget)
    made = made.select(cached.columns)
    return fresh.unionByName(made), upserted(cached, made, ["workstream_id"])


def prompt(events: DataFrame, curations: DataFrame, budget: int, now: str, covered: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(workstream_id, prompt): clock, budget, the event covered through, all events by category, best first, with what people have noted on them and why, and the orientation of an earlier bundle.

    covered: workstream_id, event_id (``scans.latest``); prior: rows of ``BUNDLE``. Nothing is left out:
    who wants a bounded prompt bounds the events.
    """
    why = F.col("rationale") if "rationale" in curations.columns else F.lit(None).cast("string")
    note = F.concat(F.lit("    * "), F.element_at(F.array(*map(F.lit, S.CURATIONS)), F.col("kind") + 1), F.lit(" by "), F.col("curator"), F.coalesce(F.concat(F.lit(": "), truncated(why, 200)), F.lit("")))
    notes = curations.where("not reverted").withColumnRenamed("target_id", "event_id").join(events.select("event_id"), "event_id", "left_semi")
    notes = notes.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("occurred_at", "curation_id", note.alias("note")))).alias("x")).select("event_id", F.array_join("x.note", "\n").alias("notes"))
    line = F.concat_ws("\n", F.concat(F.lit("- ["), F.col("event_id"), F.lit("] (score="), F.format_number("score", 2), F.lit(", valid_at="), F.date_format("valid_at", "yyyy-MM-dd HH:mm:ss"), F.lit(") "), truncated(F.col("text"), 400)), F.col("notes"))
    rows = events.join(notes, "event_id", "left").withColumn("line", line).withColumn("rank", category_rank(F.col("category")))
    name = F.element_at(F.array(*map(F.lit, S.CATEGORIES)), F.col("category") + 1)
    item = F.struct(*[F.expr(o).alias(f"o{i}") for i, o in enumerate(_ORDER)], "line")
    by = rows.groupBy("workstream_id", "rank", name.alias("name")).agg(F.count("*").alias("c"), F.array_sort(F.collect_list(item)).alias("x"))
    block = F.concat(F.lit("== "), F.col("name"), F.lit(" ("), F.col("c").cast("string"), F.lit(") ==\n"), F.array_join(F.col("x.line"), "\n"))
    out = by.groupBy("workstream_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    out = out.join(covered.select("workstream_id", F.col("event_id").alias("covered")), "workstream_id", "left")
    head = F.concat(F.lit("Workstream: "), F.col("workstream_id"), F.lit(f"\nGenerated at: {now}\nToken budget: {budget}\nEvents covered through: "), F.coalesce("covered", F.lit("none")), F.lit("\n\n"))
    out = out.select("workstream_id", F.concat(head, F.array_join(F.col("b.block"), "\n\n")).alias("prompt"))
    if prior is None:
        return out
    tail = F.concat(F.lit("\n\nPRIOR BUNDLE (keep the sections that still hold):\n"), F.col("orientation"))
    out = out.join(prior.select("workstream_id", "orientation"), "workstream_id", "left")
    return out.select("workstream_id", F.concat("prompt", F.coalesce(tail, F.lit(""))).alias("prompt"))


def stale(cached: DataFrame, log: DataFrame, curations: DataFrame) -> DataFrame:
    """(workstream_id, stale): another latest event, or a curation after the bundle was made."""
    from .scans import latest

    now = latest(log).select("workstream_id", F.col("event_id").alias("latest_event"))
    curated = curations.join(log.select(F.col("event_id").alias("target_id"), "workstream_id"), "target_id").groupBy("workstream_id").agg(F.max("occurred_at").alias("curated_at"))
    both = cached.join(now, "workstream_id", "left").join(curated, "workstream_id", "left")
    return both.select("workstream_id", (~F.col("covered_through").eqNullSafe(F.col("latest_event")) | F.coalesce(F.col("curated_at") > F.col("generated_at"), F.lit(False))).alias("stale"))
