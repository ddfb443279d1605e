"""What follows each micro-batch (W4, W5, K5, K7, K18): projections, the full-text index and feedback, kept beside the log.

New rows meet what is kept already by delta joins (new with old, old with new, new with new), which open only the buckets
that the new rows' keys fall into. Every table knows the last batch that changed it, so a batch that is
run again goes on where it failed. After any order of batches the tables are those of a rebuild.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import payloads as P
from ..operators import projections as J
from ..operators.textindex import IndexStore
from ..sources.versioned import Versioned, bucket_of
from .ingest import Store

STATEMENT = "workstream_id string, event_id string, statement string, principal_id string, supporting string, valid_at timestamp_ntz"
SKILL = "workstream_id string, event_id string, name string, procedure string, valid_at timestamp_ntz"
TRIPLE = "workstream_id string, event_id string, ordinal int, subject_key string, predicate string, object string, valid_at timestamp_ntz"
CONTRADICTION = "workstream_id string, subject_key string, predicate string, event_a string, event_b string, object_a string, object_b string, detected_at timestamp_ntz"
FACT_KEY = "workstream_id string, key string, event_id string, created_at timestamp_ntz, valid_at timestamp_ntz"
DUPLICATE = "workstream_id string, canonical_event string, duplicate_event string, detected_at timestamp_ntz"
#: A decision, action or outcome as its chain needs it.
LINK = "workstream_id string, event_id string, category int, decision_ref string, action_ref string, polarity int, supporting array<string>, created_at timestamp_ntz, valid_at timestamp_ntz"
CHAIN = "workstream_id string, decision_id string, decision_at timestamp_ntz, action_id string, outcome_id string, polarity int, closed boolean"
WEIGHT = "event_id string, weight double, updates bigint"


def widened(rows: DataFrame) -> DataFrame:
    """Log rows with the typed fields of their payloads as columns."""
    p = P.parsed(F.col("payload"))
    skill = P.kind(p) == "skill"
    return rows.withColumns({
        "statement": F.when(skill, p["procedure"]).otherwise(F.coalesce(p["statement"], p["content"])), "skill_name": F.when(skill, p["name"]), "supporting": p["supportingEvents"], "triples": p["triples"],
        "decision_ref": p["decisionEvent"], "action_ref": p["actionEvent"], "polarity": p["polarity"], "content": P.index_text(p),
    })


@dataclass(frozen=True)
class Projector:
    """A name, the categories that it takes in (F13), and what it does with such rows of a batch."""

    name: str
    categories: tuple[int, ...]
    apply: Callable[[DataFrame, int], None]


class Failed(RuntimeError):
    """A projector has failed; the events are logged as failed, and later projectors have not run."""


def pipeline(store: Store, projectors: Iterable[Projector]) -> Callable[[DataFrame, int], None]:
    """K7: an observer that applies each projector whose categories a batch has, in order, and logs (event_id, status, error) by projector and batch.

    The first that fails is logged as failed, with its error, and ends the run with ``Failed``; run again, the batch replaces what it has logged.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        for p in projectors:
            mine = rows.where(F.col("category").isin(*p.categories))
            if not mine.take(1):
                continue
            error = None
            try:
                p.apply(mine, batch_id)
            except Exception as e:  # any failure of a projector is logged, then raised
                error = e
            status = mine.select("event_id", F.lit("Failed" if error else "Applied").alias("status"), F.lit(f"{type(error).__name__}: {error}"[:1000] if error else None).cast("string").alias("error"))
            store.put(f"processing/projection={p.name}", status, batch_id)
            if error:
                raise Failed(p.name) from error

    return run


def processing(store: Store) -> DataFrame:
    """K7: (projection, event_id, status, error) of all batches."""
    return store.read("processing", "projection string, event_id string, status string, error string")


class Derived:
    """The kept tables and the observers that keep them."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        table = lambda name, ddl, by: Versioned(spark, f"{folder}/{name}", ddl, by, buckets)
        self.statements = {c: table(n, STATEMENT, "event_id") for c, n in ((S.FACT, "facts"), (S.DECISION, "decisions"), (S.HYPOTHESIS, "hypotheses"), (S.GOAL, "goals"))}
        self.skills = table("skills", SKILL, "event_id")
        self.triples, self.contradictions = table("triples", TRIPLE, "subject_key"), table("contradictions", CONTRADICTION, "subject_key")
        self.fact_keys, self.duplicates = table("fact_keys", FACT_KEY, "key"), table("duplicates", DUPLICATE, "canonical_event")
        # decisions by their own id, actions by their decision and by their own id, outcomes by their action
        self.decided, self.acted, self.actions, self.outcomes = table("decided", LINK, "event_id"), table("acted", LINK, "decision_ref"), table("actions", LINK, "event_id"), table("outcomes", LINK, "action_ref")
        self.chains, self.weights = table("decision_chains", CHAIN, "decision_id"), table("weights", WEIGHT, "event_id")
        self.index = IndexStore(spark, f"{folder}/text", min(buckets, 32))

    def of(self, t: Versioned, ids: DataFrame, column: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a table whose bucket key is among ids (one column): a bounded number of bucket numbers goes to the driver, never an id."""
        name = ids.columns[0]
        some = [r[0] for r in ids.select(bucket_of(F.col(name), t.buckets)).distinct().collect()]
        keys = ids.where(F.col(name).isNotNull()).distinct().withColumnRenamed(name, column or t.by)
        return t.read(some, version).join(keys, column or t.by, "left_semi").select(*t.read([]).columns)

    # ---- projectors, in order ----

    def projectors(self) -> list[Projector]:
        out = [Projector(name, (c,), lambda r, b, c=c: self._statement(c, r, b)) for c, name in ((S.FACT, "facts"), (S.DECISION, "decisions"), (S.HYPOTHESIS, "hypotheses"), (S.GOAL, "goals"))]
        out.append(Projector("skills", (S.EVIDENCE,), self._skills))
        out += [Projector("triples", (S.FACT,), self._triples), Projector("contradictions", (S.FACT,), self._contradictions), Projector("duplicates", (S.FACT,), self._duplicates)]
        return [*out, Projector("decision_chains", (S.DECISION, S.ACTION, S.OUTCOME), self._chains)]

    def _statement(self, category: int, rows: DataFrame, batch: int) -> None:
        rows = widened(rows).withColumn("supporting", F.to_json("supporting"))
        self.statements[category].append(rows.select(*self.statements[category].read([]).columns), batch)

    def _skills(self, rows: DataFrame, batch: int) -> None:
        rows = widened(rows).where("skill_name is not null")
        self.skills.append(rows.select("workstream_id", "event_id", F.col("skill_name").alias("name"), F.col("statement").alias("procedure"), "valid_at"), batch)

    def _triples(self, rows: DataFrame, batch: int) -> None:
        self.triples.append(J.triples_of(widened(rows)), batch)

    def _contradictions(self, rows: DataFrame, batch: int) -> None:
        new = J.triples_of(widened(rows)).persist()
        try:
            old = self.of(self.triples, new.select("subject_key"), version=self.triples.before(batch))
            self.contradictions.append(J.contradictions(new).unionByName(J.contradictions(new, old)), batch)
        finally:
            new.unpersist()

    def _duplicates(self, rows: DataFrame, batch: int) -> None:
        new = J.fact_keys(widened(rows)).persist()
        try:
            self.fact_keys.append(new, batch)
            old = self.of(self.fact_keys, new.select("key"), version=self.fact_keys.before(batch))
            self.duplicates.append(J.duplicate_pairs(new).unionByName(J.duplicate_pairs(new, old)), batch)
        finally:
            new.unpersist()

    def _chains(self, rows: DataFrame, batch: int) -> None:
        """Chains of the decisions that new rows touch, from what is known now: an action without its decision gives a stub, a decision fills it in, an outcome waits for its action."""
        links = widened(rows).select(*self.decided.read([]).columns).persist()
        try:
            of = lambda c: links.where(F.col("category") == c)
            actions, outcomes = of(S.ACTION).where("decision_ref is not null"), of(S.OUTCOME).where("action_ref is not null")
            self.decided.append(of(S.DECISION), batch)
            self.acted.append(actions, batch)
            self.actions.append(actions, batch)
            self.outcomes.append(outcomes, batch)
            closed = self.of(self.actions, outcomes.select("action_ref")).select("decision_ref")
            touched = of(S.DECISION).select(F.col("event_id").alias("decision_ref")).union(actions.select("decision_ref")).union(closed).distinct().persist()
            acts = self.of(self.acted, touched)
            known = self.of(self.decided, touched).unionByName(acts).unionByName(self.of(self.outcomes, acts.select("event_id")))
            chains = J.decision_chains(known).withColumn("polarity", F.col("polarity").cast("int"))
            self.chains.upsert(chains.select(*self.chains.read([]).columns), ["workstream_id", "decision_id"], batch=batch)
            touched.unpersist()
        finally:
            links.unpersist()

    # ---- after the projectors ----

    def indexed(self, rows: DataFrame, batch: int) -> None:
        """K3: the batch's texts join the full-text index."""
        self.index.add(widened(rows).select("event_id", "workstream_id", "created_at", "content"), batch)

    def learned(self, rows: DataFrame, batch: int) -> None:
        """New outcomes move the weights of their decision and its supporters, as far as action and decision are known."""
        outcomes = widened(rows).where(F.col("category") == S.OUTCOME).select(*self.outcomes.read([]).columns)
        if not outcomes.take(1):
            return
        acts = self.of(self.actions, outcomes.select("action_ref"))
        known = outcomes.unionByName(acts).unionByName(self.of(self.decided, acts.select("decision_ref")))
        maps = J.feedback_maps(J.feedback_steps(known)).persist()
        try:
            had = self.of(self.weights, maps.select("event_id"), version=self.weights.before(batch)).select("event_id", F.col("weight").alias("had"), F.col("updates").alias("before"))
            now = maps.join(had, "event_id", "left").select("event_id", J.moved(F.coalesce("had", F.lit(J.WEIGHT_START))).alias("weight"), (F.col("updates") + F.coalesce("before", F.lit(0))).alias("updates"))
            self.weights.upsert(now, batch=batch)
        finally:
            maps.unpersist()

    def observers(self, store: Store) -> list[Callable[[DataFrame, int], None]]:
        """In order: projectors, the full-text index, feedback."""
        return [pipeline(store, self.projectors()), self.indexed, self.learned]

    def contradicted(self, workstream: str | None = None) -> DataFrame:
        rows = self.contradictions.read()
        return rows if workstream is None else rows.where(F.col("workstream_id") == workstream)
