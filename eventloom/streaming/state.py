"""What a store keeps besides its log (K14, K16, K17, K25, S13, S23): configuration, session offsets and runs, bundles, entities, each a keyed table that changes in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import popularity
from ..operators import bundle
from ..operators.gates import workstream_id
from ..sources.versioned import Versioned

#: Modes of a workstream by their code.
MODES = ("AutoDistill", "ReviewBeforeDistill")
CONFIG = "workstream_id string, mode int, opted_in boolean, updated_at timestamp_ntz"
MARK = "session_id string, last_entry string, distilled_at timestamp_ntz, distiller string"
RUN = "session_id string, from_entry string, to_entry string, n_events bigint"
ENTITY = "entity_id string, workstream_id string, kind string, display_name string, mention_count bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, weight double"
MENTION = "entity_id string, event_id string, seen_at timestamp_ntz"


class Kept:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        table = lambda name, ddl, by: Versioned(spark, f"{folder}/{name}", ddl, by, buckets)
        self.spark = spark
        self.config, self.watermarks, self.runs = table("config", CONFIG, "workstream_id"), table("watermarks", MARK, "session_id"), table("runs", RUN, "session_id")
        self.bundles, self.entities, self.mentions = table("bundles", bundle.BUNDLE, "workstream_id"), table("entities", ENTITY, "entity_id"), table("mentions", MENTION, "entity_id")

    # ---- K25 ----

    def mode(self, workstream: str) -> str:
        """The mode of a workstream; the first where none is set."""
        row = self.config.of_keys([workstream]).first()
        return MODES[row["mode"] if row and row["mode"] is not None else 0]

    def takes_part(self, workstream: str) -> bool:
        row = self.config.of_keys([workstream]).first()
        return bool(row and row["opted_in"])

    def configure(self, workstream: str, now: str, mode: str | None = None, opted_in: bool | None = None) -> None:
        """Set a workstream's mode, its part in fleet runs, or both; what is not given stays."""
        had = self.config.of_keys([workstream_id(workstream)]).first()
        code = MODES.index(mode) if mode is not None else had["mode"] if had else 0
        part = opted_in if opted_in is not None else had["opted_in"] if had else False
        row = self.spark.createDataFrame([(workstream, code, part)], "workstream_id string, mode int, opted_in boolean")
        self.config.upsert(row.withColumn("updated_at", F.lit(now).cast("timestamp_ntz")))

    # ---- K16 ----

    def session_run(self, result: dict[str, DataFrame]) -> None:
        """Write what ``sessions.distil_run`` has found: runs first, since offsets that moved would hide their entries for good."""
        runs = result["runs"].persist()
        marks = result["watermarks"].persist()
        try:
            marks.count()
            self.runs.upsert(runs.select("session_id", "from_entry", "to_entry", F.col("n_events").cast("long").alias("n_events")), ["session_id", "from_entry", "to_entry"])
            self.watermarks.upsert(marks)
        finally:
            runs.unpersist()
            marks.unpersist()

    # ---- S23, K17 ----

    def served(self, workstreams: list[str], events: DataFrame, log: DataFrame, curations: DataFrame, now: str, budget: int = 4096, **more) -> DataFrame:
        """Bundles of some workstreams, from the cache while they are fresh; those made anew replace the cached ones, in their buckets alone."""
        mine = lambda t: t.where(F.col("workstream_id").isin(*workstreams))
        cached = self.bundles.of_keys(workstreams).persist()
        out, _ = bundle.served(cached, mine(events), mine(log), curations, now, budget, **more)
        out = out.persist()
        try:
            made = out.join(cached.select("workstream_id", "generated_at"), ["workstream_id", "generated_at"], "left_anti")
            if made.take(1):
                self.bundles.upsert(made)
            return self.bundles.of_keys(workstreams)
        finally:
            out.unpersist()
            cached.unpersist()

    # ---- K14 ----

    def mentioned(self, entities: DataFrame, mentions: DataFrame) -> None:
        """New entities join, known ones stay; mentions of an event count once; counts, sights and weights of the mentioned entities follow.

        entities: entity_id, workstream_id, kind, display_name; mentions: entity_id, event_id, seen_at.
        """
        self.mentions.upsert(mentions.groupBy("entity_id", "event_id").agg(F.min("seen_at").alias("seen_at")), ["entity_id", "event_id"])
        ids = mentions.select("entity_id").unionByName(entities.select("entity_id")).distinct()
        every = self.mentions.read().join(ids, "entity_id", "left_semi")
        stats = every.groupBy("entity_id").agg(F.count("*").alias("mention_count"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
        had = self.entities.read().join(ids, "entity_id", "left_semi").select("entity_id", "workstream_id", "kind", "display_name")
        rows = had.unionByName(entities.select(*had.columns).dropDuplicates(["entity_id"]).join(had.select("entity_id"), "entity_id", "left_anti"))
        rows = rows.join(stats, "entity_id", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0)))
        self.entities.upsert(rows.withColumn("weight", popularity(F.greatest("mention_count", F.lit(1)))))
