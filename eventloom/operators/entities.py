"""Entity resolution."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as R
from ..functions.text import canonical_entity, entity_id, popularity

#: Cosine from which two names are one entity; candidates of the tiers.
SAME, TIER2, TIER3 = 0.95, 200, 50
KINDS = {"email": 0, "login": 1, "linear": 2, "slack": 3, "stripe": 4, "url": 5, "name": 6, "other": 99}


def resolved(raw: DataFrame) -> DataFrame:
    """Tier 1: raw rows (workstream_id, kind, raw) with canonical key and the id it determines (null without a key)."""
    code = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind"))
    out = raw.withColumn("canonical", canonical_entity(F.col("kind"), F.col("raw")))
    return out.withColumn("entity_id", F.when(F.col("canonical") != "", entity_id(F.col("workstream_id"), code, F.col("canonical"))))


def mention_stats(mentions: DataFrame, key: str = "entity_id") -> DataFrame:
    """Count of distinct events, first and last sight, popularity."""
    out = mentions.groupBy(key).agg(F.countDistinct("event_id").alias("mention_count"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    return out.withColumn("weight", popularity(F.col("mention_count")))


def nearest_entities(new: DataFrame, known: DataFrame) -> DataFrame:
    """Tier 2: for each new name (new_id, workstream_id, kind, v) the nearest of the TIER2 most mentioned entities of its workstream and kind, if it is the same by cosine.

    The candidates of a (workstream, kind) are at most TIER2, so the join grows with the new names only.
    """
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("workstream_id", "kind").orderBy(F.col("mention_count").desc(), F.col("last_seen").desc(), "entity_id"))
    pool = known.withColumn("place", place).where(F.col("place") <= TIER2).select("workstream_id", "kind", "entity_id", F.col("v").alias("w"))
    scored = new.join(pool, ["workstream_id", "kind"]).withColumn("cosine", R.cosine(F.col("v"), F.col("w")))
    best = scored.groupBy("new_id").agg(F.max(F.struct("cosine", "entity_id")).alias("x"))
    return best.where(F.col("x.cosine") >= SAME).select("new_id", F.col("x.entity_id").alias("entity_id"), F.col("x.cosine").alias("cosine"))


def first_subjects(triples: DataFrame) -> DataFrame:
    """A5: the first event of each subject."""
    return triples.groupBy("workstream_id", "subject_key").agg(F.min("event_id").alias("first_event"))


def stamped(triples: DataFrame, resolved_subjects: DataFrame) -> DataFrame:
    """Triples get the id of their subject where they have none."""
    found = resolved_subjects.select("workstream_id", "subject_key", F.col("entity_id").alias("_id"))
    return triples.join(found, ["workstream_id", "subject_key"], "left").withColumn("subject_entity_id", F.coalesce("subject_entity_id", "_id")).drop("_id")


def state_hash(kind: Column, key: Column, name: Column, mentions: Column) -> Column:
    """Guards a merge against an entity that has changed since it was proposed."""
    return F.upper(F.sha2(F.concat(F.lit("v1|kind="), kind.cast("string"), F.lit("|key="), key, F.lit("|name="), name, F.lit("|mentions="), mentions.cast("string")), 256))


def candidate_pairs(new: DataFrame, known: DataFrame, most: int = TIER3) -> DataFrame:
    """S20, tier 3: each new name with the ``most`` entities of its workstream and kind that are mentioned most (new_id, name, entity_id, display_name, hash)."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("workstream_id", "kind").orderBy(F.col("mention_count").desc(), F.col("last_seen").desc(), "entity_id"))
    code = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind"))
    pool = known.withColumn("place", place).where(F.col("place") <= most)
    pool = pool.select("workstream_id", "kind", "entity_id", "display_name", state_hash(code, F.coalesce("canonical", F.lit("")), F.col("display_name"), F.col("mention_count")).alias("hash"))
    return new.join(pool, ["workstream_id", "kind"]).where("new_id <> entity_id")


def proposals(pairs: DataFrame, proposer: Callable[[pd.DataFrame], pd.DataFrame], proposed_by: str, now: str, least: float = 0.5) -> DataFrame:
    """A host's proposer (pandas function over Arrow batches of pairs, adding confidence and rationale) proposes merges; those from ``least`` confidence up are kept."""
    from pyspark.sql import types as T

    out = T.StructType([*pairs.schema.fields, T.StructField("confidence", T.DoubleType()), T.StructField("rationale", T.StringType())])
    judged = pairs.mapInPandas(lambda batches: (proposer(b) for b in batches), out).where(F.col("confidence") >= least)
    number = F.concat(F.lit("prop-"), F.substring(F.sha2(F.concat_ws("|", "workstream_id", "entity_id", "new_id"), 256), 1, 32))
    return judged.select(
        number.alias("proposal_id"), "workstream_id", F.col("entity_id").alias("winner_id"), F.array("new_id").alias("loser_ids"), "confidence", "rationale", F.lit(proposed_by).alias("proposed_by"),
        F.lit(now).cast("timestamp_ntz").alias("proposed_at"), F.col("hash").alias("winner_state_hash"), F.lit("proposed").alias("status"),
    )


def proposals_decided(open_: DataFrame, decisions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals afterwards, merges to append, refused with a reason). decisions: proposal_id, action ('confirm' or 'reject').

    A confirmation needs the winner to be as it was when the merge was proposed; only open proposals change.
    entities: entity_id, hash (R17).
    """
    now = entities.select(F.col("entity_id").alias("winner_id"), F.col("hash").alias("now"))
    rows = open_.join(decisions.select("proposal_id", "action"), "proposal_id", "left").join(now, "winner_id", "left")
    reason = F.when(F.col("action").isNull(), F.lit(None)).when(F.col("status") != "proposed", F.lit("not open")).when((F.col("action") == "confirm") & ~F.col("now").eqNullSafe(F.col("winner_state_hash")), F.lit("stale"))
    rows = rows.withColumn("reason", reason)
    done = F.col("action").isNotNull() & F.col("reason").isNull()
    status = F.when(done & (F.col("action") == "confirm"), F.lit("confirmed")).when(done & (F.col("action") == "reject"), F.lit("rejected")).otherwise(F.col("status"))
    after = rows.withColumn("status", status)
    merges = after.where(done & (F.col("action") == "confirm")).select("workstream_id", "winner_id", F.explode("loser_ids").alias("loser_id"), "proposal_id")
    return after.select(*open_.columns), merges, rows.where("reason is not null").select("proposal_id", "action", "reason")


def resolve(new: DataFrame, known: DataFrame) -> DataFrame:
    """(new_id, entity_id, tier): 1 by canonical key, 2 by the nearest name, 0 a new entity (whose id it keeps), for which tier 3 proposes merges.

    new: new_id, workstream_id, kind, raw, v (null where there is no vector); known: entities with canonical, mention_count, last_seen, v.
    """
    keyed = resolved(new.select("new_id", "workstream_id", "kind", "raw")).withColumnRenamed("entity_id", "own")
    have = known.select(F.col("entity_id").alias("own"), F.lit(1).alias("have")).distinct()
    one = keyed.join(have, "own", "left").where("have = 1").select("new_id", F.col("own").alias("entity_id"), F.lit(1).alias("tier"))
    rest = new.join(one.select("new_id"), "new_id", "left_anti")
    two = nearest_entities(rest.where("v is not null").select("new_id", "workstream_id", "kind", "v"), known.where("v is not null")).select("new_id", "entity_id", F.lit(2).alias("tier"))
    fresh = rest.join(two.select("new_id"), "new_id", "left_anti").join(keyed.select("new_id", "own"), "new_id")
    return one.unionByName(two).unionByName(fresh.select("new_id", F.coalesce("own", "new_id").alias("entity_id"), F.lit(0).alias("tier")))


def resolve_subjects(triples: DataFrame, known: DataFrame, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """One pass over subjects without an entity: each is resolved as a name once (E9), its triples get the id, its first event becomes a mention.

    triples: workstream_id, event_id, subject_key, subject_entity_id, ...; known: as ``resolve`` takes it;
    vectors: workstream_id, subject_key, v. Returns triples, mentions (entity_id, event_id), entities to add (K14) and
    the subjects resolved. A second pass finds nothing to do.
    """
    subjects = first_subjects(triples.where("subject_entity_id is null")).withColumn("new_id", F.concat(F.lit("name-"), F.sha2(F.concat_ws("|", "workstream_id", "subject_key"), 256)))
    subjects = subjects.join(vectors, ["workstream_id", "subject_key"], "left") if vectors is not None else subjects.withColumn("v", F.lit(None).cast("array<double>"))
    new = subjects.select("new_id", "workstream_id", F.lit("name").alias("kind"), F.col("subject_key").alias("raw"), "v")
    found = subjects.join(resolve(new, known), "new_id").select("workstream_id", "subject_key", "first_event", "entity_id", "tier")
    added = found.where("tier = 0").select("entity_id", "workstream_id", F.lit("name").alias("kind"), F.col("subject_key").alias("display_name"))
    return {"triples": stamped(triples, found), "mentions": found.select("entity_id", F.col("first_event").alias("event_id")), "entities": inserted(known, added), "subjects": found}


def inserted(known: DataFrame, new: DataFrame) -> DataFrame:
    """The entities of new rows that are not known yet, each once (of several names the first)."""
    first = new.groupBy("entity_id", "workstream_id", "kind").agg(F.min("display_name").alias("display_name"))
    return first.join(known.select("entity_id"), "entity_id", "left_anti")
