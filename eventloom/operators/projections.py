"""Derived tables of the log (K5, F24, J8, J9, A9, A10), always in their rebuild form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import normalized, subject_key


def facts(log: DataFrame, revocations: DataFrame) -> DataFrame:
    rows = log.where(F.col("category") == S.FACT).join(revocations, "event_id", "left")
    return rows.select("workstream_id", "event_id", "statement", F.to_json("supporting").alias("supporting"), "valid_at", "revoked_at")


def statements(log: DataFrame, revocations: DataFrame, category: int) -> DataFrame:
    """Decisions, hypotheses and goals."""
    rows = log.where(F.col("category") == category).join(revocations, "event_id", "left")
    return rows.select("workstream_id", "event_id", "statement", "principal_id", "valid_at", "revoked_at")


def skills(log: DataFrame, revocations: DataFrame) -> DataFrame:
    """Skills travel as evidence with a skill payload."""
    rows = log.where((F.col("category") == S.EVIDENCE) & F.col("skill_name").isNotNull()).join(revocations, "event_id", "left")
    return rows.select("workstream_id", "event_id", F.col("skill_name").alias("name"), F.col("statement").alias("procedure"), "valid_at", "revoked_at")


def triples_of(facts_with_triples: DataFrame) -> DataFrame:
    """(workstream_id, event_id, ordinal, subject_key, predicate, object); invalid triples are skipped before they are numbered."""
    ok = F.filter("triples", lambda t: (F.coalesce(subject_key(t["subject"]), F.lit("")) != "") & (F.coalesce(F.trim(t["predicate"]), F.lit("")) != "") & (F.coalesce(F.trim(t["object"]), F.lit("")) != ""))
    rows = facts_with_triples.select("workstream_id", "event_id", "valid_at", F.posexplode(ok).alias("ordinal", "t"))
    return rows.select("workstream_id", "event_id", "ordinal", subject_key(F.col("t.subject")).alias("subject_key"), F.col("t.predicate").alias("predicate"), F.col("t.object").alias("object"), "valid_at")


def triples(log: DataFrame) -> DataFrame:
    one = F.array(F.struct("subject", "predicate", "object"))
    return triples_of(log.where(F.col("category") == S.FACT).withColumn("triples", one))


#: What contradictions are about.
ABOUT = ["workstream_id", "subject_key", "predicate"]


def said(triples_: DataFrame) -> DataFrame:
    """One row for each fact and (subject, predicate): its first object (``v`` in normal form, ``object``, ``at``) and the first that differs from it (``object2``, ``at2``; null if all agree).

    Rows are dealt by (subject, predicate) into as many parts as shuffles have, which Spark does not merge
    however small they are: what grows with the square of a subject's facts is the join that follows.
    """
    n = int(triples_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = triples_.select(*ABOUT, "event_id", F.struct("ordinal", "object", "valid_at", normalized(F.col("object")).alias("v")).alias("x")).where("x.v is not null")
    each = rows.repartition(n, *ABOUT).groupBy(*ABOUT, "event_id").agg(F.array_sort(F.collect_list("x")).alias("x")).withColumn("one", F.col("x")[0])
    each = each.withColumn("two", F.get(F.filter("x", lambda y: y["v"] != F.col("one.v")), F.lit(0)))
    return each.select(*ABOUT, "event_id", F.col("one.v").alias("v"), F.col("one.object").alias("object"), F.col("one.valid_at").alias("at"), F.col("two.object").alias("object2"), F.col("two.valid_at").alias("at2"))


def contradictions(triples_: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Pairs of facts that say something else of one subject and predicate; each pair once, with the first objects that differ. With ``others``: pairs of one of triples_ and one of others, which share no fact.

    Each fact's triples are brought together before facts meet, so pairs leave the join as they are: none is sorted, shuffled or grouped.
    """

    def side(of: DataFrame, x: str) -> DataFrame:
        return of.select(*ABOUT, *(F.col(c).alias(f"{c}_{x}") for c in ("event_id", "v", "object", "at", "object2", "at2")))

    differ = "v_a <> v_b or object2_a is not null or object2_b is not null"
    facts_, more = said(triples_), None if others is None else said(others)
    pairs = _both_ways(lambda p, q: side(p, "a").join(side(q, "b"), ABOUT).where(f"event_id_a < event_id_b and ({differ})"), facts_, more)
    # a's first object goes with the first of b that differs from it; where all of b agree with it, b's first goes with a's second
    second_b, second_a = F.expr("object2_b is not null and v_a = v_b"), F.expr("object2_a is not null and object2_b is null and v_a = v_b")
    a, b = (lambda c: F.when(second_a, F.col(f"{c}2_a")).otherwise(F.col(f"{c}_a"))), (lambda c: F.when(second_b, F.col(f"{c}2_b")).otherwise(F.col(f"{c}_b")))
    return pairs.select(*ABOUT, F.col("event_id_a").alias("event_a"), F.col("event_id_b").alias("event_b"), a("object").alias("object_a"), b("object").alias("object_b"), F.greatest(a("at"), b("at")).alias("detected_at"))


def _two(n):
    """How many pairs n rows give."""
    return F.coalesce(F.sum(F.shiftright(n * (n - 1), 1)), F.lit(0))


def contradiction_count(triples_: DataFrame) -> DataFrame:
    """How many rows ``contradictions`` gives (n), without pairs: all pairs of facts of a (subject, predicate) but those that say one value alone, the same."""
    each = triples_.where(F.col("workstream_id").isNotNull() & F.col("event_id").isNotNull() & F.col("subject_key").isNotNull() & F.col("predicate").isNotNull())
    each = each.withColumn("v", normalized(F.col("object"))).where("v is not null").groupBy(*ABOUT, "event_id").agg(F.min("v").alias("v"), F.max("v").alias("last"))
    alike = each.groupBy(*ABOUT, F.when(F.col("v") == F.col("last"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    return alike.groupBy(*ABOUT).agg(F.sum("n").alias("all"), _two(F.when(F.col("v").isNotNull(), F.col("n"))).alias("same")).agg((_two(F.col("all")) - F.coalesce(F.sum("same"), F.lit(0))).alias("n"))


def duplicate_count(rows: DataFrame) -> DataFrame:
    """How many rows ``duplicate_pairs`` of ``fact_keys`` gives (n), without pairs: all pairs of rows of a key but those of one fact at one time."""
    each = rows.where("workstream_id is not null and key is not null and event_id is not null and created_at is not null")
    once = each.groupBy("workstream_id", "key", "created_at", "event_id").agg(F.count("*").alias("n"))
    return once.groupBy("workstream_id", "key").agg(F.sum("n").alias("all"), _two(F.col("n")).alias("same")).agg((_two(F.col("all")) - F.coalesce(F.sum("same"), F.lit(0))).alias("n"))


def _both_ways(pairs, a: DataFrame, b: DataFrame | None) -> DataFrame:
    return pairs(a, a) if b is None else pairs(a, b).unionByName(pairs(b, a))


def fact_keys(log: DataFrame) -> DataFrame:
    """Facts by their normalised statement."""
    return log.where(F.col("category") == S.FACT).select("workstream_id", normalized(F.col("statement")).alias("key"), "event_id", "created_at", "valid_at")


def duplicates(log: DataFrame) -> DataFrame:
    """(canonical, duplicate) pairs of facts with one normalised statement, the canonical one earlier."""
    return duplicate_pairs(fact_keys(log))


def duplicate_pairs(rows: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """J9 of ``fact_keys``. With ``others``: pairs of one of rows and one of others."""

    def side(of: DataFrame, x: str, name: str) -> DataFrame:
        return of.select("workstream_id", "key", F.col("event_id").alias(name), F.col("created_at").alias(f"c{x}"), F.col("valid_at").alias(f"t{x}"))

    earlier = "ca < cb or (ca = cb and canonical_event < duplicate_event)"
    pairs = _both_ways(lambda p, q: side(p, "a", "canonical_event").join(side(q, "b", "duplicate_event"), ["workstream_id", "key"]).where(earlier), rows, others)
    return pairs.select("workstream_id", "canonical_event", "duplicate_event", F.greatest("ta", "tb").alias("detected_at"))


def decision_chains(log: DataFrame) -> DataFrame:
    """A10: each decision with its last action and that action's last outcome; actions without a decision make a stub."""
    decisions = log.where(F.col("category") == S.DECISION).select("workstream_id", F.col("event_id").alias("decision_id"), F.col("valid_at").alias("decided"))
    actions = log.where((F.col("category") == S.ACTION) & F.col("decision_ref").isNotNull())
    actions = actions.groupBy("workstream_id", F.col("decision_ref").alias("decision_id")).agg(F.max_by("event_id", F.struct("created_at", "event_id")).alias("action_id"), F.min_by("valid_at", F.struct("created_at", "event_id")).alias("acted"))
    outcomes = log.where((F.col("category") == S.OUTCOME) & F.col("action_ref").isNotNull())
    outcomes = outcomes.groupBy(F.col("action_ref").alias("action_id")).agg(F.max(F.struct("created_at", "event_id", "polarity")).alias("o"))
    chains = decisions.join(actions, ["workstream_id", "decision_id"], "full_outer").join(outcomes, "action_id", "left")
    return chains.select("workstream_id", "decision_id", F.coalesce("decided", "acted").alias("decision_at"), "action_id", F.col("o.event_id").alias("outcome_id"), F.col("o.polarity").alias("polarity"), F.col("o.event_id").isNotNull().alias("closed"))


def feedback_steps(log: DataFrame) -> DataFrame:
    """Outcome, action, decision: (event_id, at, outcome_id, delta) for the decision and each different supporter of it."""
    outcomes = log.where(F.col("category") == S.OUTCOME).select(F.col("action_ref").alias("action_id"), F.col("event_id").alias("outcome_id"), F.col("created_at").alias("at"), "polarity")
    actions = log.where(F.col("category") == S.ACTION).select(F.col("event_id").alias("action_id"), F.col("decision_ref").alias("decision_id"))
    decisions = log.where(F.col("category") == S.DECISION).select(F.col("event_id").alias("decision_id"), "supporting")
    walk = outcomes.join(actions, "action_id").join(decisions, "decision_id")
    targets = F.array_distinct(F.concat(F.array("decision_id"), F.coalesce("supporting", F.array().cast("array<string>"))))
    delta = 0.1 * ((F.col("polarity") + 1) / 2.0 - 0.5)
    return walk.select(F.explode(targets).alias("event_id"), "at", "outcome_id", delta.alias("delta"))


#: A weight's bounds and start.
WEIGHT_LOW, WEIGHT_HIGH, WEIGHT_START = 0.1, 5.0, 1.0
#: Rows of one fold are at most 2 ** FOLD_BITS.
FOLD_BITS = 10


def _folded(rows: DataFrame, *by: str) -> DataFrame:
    """Maps (n, low, high, shift, updates) composed in order of n by some columns: a weight w becomes min(high, max(low, w + shift))."""
    start = F.struct(F.lit(WEIGHT_LOW).alias("low"), F.lit(WEIGHT_HIGH).alias("high"), F.lit(0.0).alias("shift"))

    def then(a, x):
        clamp = lambda v: F.least(x["high"], F.greatest(x["low"], v + x["shift"]))
        return F.struct(clamp(a["low"]).alias("low"), clamp(a["high"]).alias("high"), (a["shift"] + x["shift"]).alias("shift"))

    steps = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "low", "high", "shift"))).alias("x"), F.sum("updates").alias("updates"))
    return steps.withColumn("x", F.aggregate("x", start, then)).select(*by, "x.low", "x.high", "x.shift", "updates")


def feedback_maps(steps: DataFrame) -> DataFrame:
    """What the steps of each target, in order, do to its weight: (event_id, low, high, shift, updates).

    Each step is clamped, so steps do not add up; but clamped steps compose into one of the same form, and
    composing is associative. So steps are dealt by ranges of (target, time), numbered, folded by runs of
    at most 1,024, then runs by runs: no row ever holds all steps of a target.
    """
    order = ["event_id", "at", "outcome_id"]
    n = F.monotonically_increasing_id()
    rows = steps.repartitionByRange(*order).sortWithinPartitions(*order).select("event_id", n.alias("n"), F.lit(WEIGHT_LOW).alias("low"), F.lit(WEIGHT_HIGH).alias("high"), F.col("delta").alias("shift"), F.lit(1).cast("long").alias("updates"))
    for _ in range(2):
        rows = _folded(rows.withColumn("run", F.shiftright("n", FOLD_BITS)), "event_id", "run").withColumnRenamed("run", "n")
    return _folded(rows, "event_id")


def moved(weight, low: str = "low", high: str = "high", shift: str = "shift"):
    """A weight after a target's steps."""
    return F.least(F.col(high), F.greatest(F.col(low), weight + F.col(shift)))


def feedback_weights(log: DataFrame) -> DataFrame:
    """Each target's weight moves by a tenth of score - 0.5, clamped to [0.1, 5] at each step."""
    maps = feedback_maps(feedback_steps(log))
    return maps.select("event_id", F.round(moved(F.lit(WEIGHT_START)), 6).alias("weight"), "updates")


def duplicate_groups(log: DataFrame) -> DataFrame:
    """J9 without pairs: each fact of a repeated statement with the earliest one (canonical_event) and the number of its group; grows with the facts, however hot a statement."""
    rows = log.where(F.col("category") == S.FACT).select("workstream_id", normalized(F.col("statement")).alias("key"), "event_id", "created_at")
    first = rows.groupBy("workstream_id", "key").agg(F.min(F.struct("created_at", "event_id")).alias("x"), F.count("*").alias("n")).where("n > 1")
    first = first.select("workstream_id", "key", F.col("x.event_id").alias("canonical_event"), "n")
    return rows.join(first, ["workstream_id", "key"]).select("workstream_id", "event_id", "canonical_event", F.col("n").alias("group_size"))


def contradiction_classes(triples_: DataFrame) -> DataFrame:
    """J8 without pairs: each value that a contradicted (subject, predicate) has, with its facts, the first of them, and how many facts say something else; grows with the triples, however hot a subject."""
    keys = ["workstream_id", "subject_key", "predicate"]
    each = triples_.groupBy(*keys, normalized(F.col("object")).alias("value"), "event_id").agg(F.lit(1).alias("_one"))
    values = each.groupBy(*keys, "value").agg(F.count("*").alias("facts"), F.min("event_id").alias("first_event"))
    every = triples_.groupBy(*keys).agg(F.countDistinct(normalized(F.col("object"))).alias("n_values"))
    total = values.groupBy(*keys).agg(F.sum("facts").alias("all_facts"))
    return values.join(every.where("n_values > 1"), keys).join(total, keys).select(*keys, "value", "facts", "first_event", "n_values", (F.col("all_facts") - F.col("facts")).alias("others"))
