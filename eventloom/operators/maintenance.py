"""Upkeep and views (S7, S8, S24, F13, F25, J3, J16, K4, K8, K25, R32, U5, X3, X4); the projector pipeline that runs (K7) is in streaming/observers.py."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import gates, projections


#: Texts that an embedding provider gets at once.
PROVIDER_BATCH = 64


def pending_embeddings(log: DataFrame, revocations: DataFrame, embeddings: DataFrame, provider: str) -> DataFrame:
    """Events that are not revoked and have no vector of this provider yet."""
    have = embeddings.where(F.col("provider_id") == provider).select("event_id")
    return gates.not_revoked(log, revocations).join(have, "event_id", "left_anti")


def has_embeddings(embeddings: DataFrame, provider: str) -> bool:
    """S8."""
    return bool(embeddings.where(F.col("provider_id") == provider).take(1))


def hashed_embedding(rows: DataFrame, tokens: str, dims: int = 256) -> DataFrame:
    """Rows (event_id, tokens as an array) as (event_id, embedding): counts of words in hashed places, of length one (zero for no words).

    Places are counted by an aggregate, each word once.
    """
    each = rows.select("event_id", F.explode(tokens).alias("w")).groupBy("event_id", F.pmod(F.xxhash64("w"), F.lit(dims)).cast("int").alias("place")).agg(F.count("*").cast("double").alias("n"))
    by = each.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm"))
    zero = F.array_repeat(F.lit(0.0), dims)
    return rows.select("event_id").join(by.select("event_id", vector.alias("v")), "event_id", "left").select("event_id", F.coalesce("v", zero).alias("embedding"))


def embedded(rows: DataFrame, provider: Callable[[list[str]], list], provider_id: str, text: str = "text") -> DataFrame:
    """(event_id, provider_id, embedding) by a host function that gets at most ``PROVIDER_BATCH`` texts at once; a wrong number of vectors raises."""

    def run(texts: pd.Series) -> pd.Series:
        body, vectors = texts.fillna("").tolist(), []
        for at in range(0, len(body), PROVIDER_BATCH):
            some = body[at : at + PROVIDER_BATCH]
            got = provider(some)
            if len(got) != len(some):
                raise ValueError("the provider returned another number of vectors")
            vectors += got
        return pd.Series([np.asarray(v, dtype=np.float32).tolist() for v in vectors])

    return rows.select("event_id", F.lit(provider_id).alias("provider_id"), F.pandas_udf(run, "array<float>")(F.col(text)).alias("embedding"))


def upserted(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last wins by key: new rows replace old ones."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*table.columns))


def rebuilt(log: DataFrame, revocations: DataFrame) -> dict[str, DataFrame]:
    """K6, K8: every projection, recomputed from the log; text index, vectors and feedback are not among them."""
    triples = projections.triples(log)
    return {
        "facts": projections.facts(log, revocations), "decisions": projections.statements(log, revocations, S.DECISION), "hypotheses": projections.statements(log, revocations, S.HYPOTHESIS), "goals": projections.statements(log, revocations, S.GOAL),
        "skills": projections.skills(log, revocations), "triples": triples, "contradictions": projections.contradictions(triples), "duplicates": projections.duplicates(log), "decision_chains": projections.decision_chains(log),
    }


def rebuild_counts(log: DataFrame, revocations: DataFrame) -> DataFrame:
    """K7, K8: (projection, n), one row for each projection; pairs are counted by their groups, none is made."""
    counts = {name: t.agg(F.count("*").alias("n")) for name, t in rebuilt(log, revocations).items()}
    counts |= {"contradictions": projections.contradiction_count(projections.triples(log)), "duplicates": projections.duplicate_count(projections.fact_keys(log))}
    parts = [t.select(F.lit(name).alias("projection"), "n") for name, t in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reranked(candidates: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """Candidates (event_id, place) by a reranker's scores; unknown ids are ignored, without any score the places stay."""
    both = candidates.join(scores.select("event_id", F.col("score").alias("_s")), "event_id", "left")
    return both.orderBy(F.col("_s").desc_nulls_last(), "place", "event_id").limit(limit).drop("_s")


def with_extras(top: DataFrame, extras: DataFrame) -> DataFrame:
    """The top events, then extras that are not among them."""
    return top.unionByName(extras.select("event_id", F.lit(None).cast("double").alias("score")).distinct().join(top.select("event_id"), "event_id", "left_anti"))


#: The categories whose events a projection takes in, in the order in which projections apply.
PROJECTIONS = {"facts": (S.FACT,), "decisions": (S.DECISION,), "hypotheses": (S.HYPOTHESIS,), "goals": (S.GOAL,), "skills": (S.EVIDENCE,), "triples": (S.FACT,), "contradictions": (S.FACT,), "duplicates": (S.FACT,), "decision_chains": (S.DECISION, S.ACTION, S.OUTCOME)}


def processing_log(rows: DataFrame, failures: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """(event_id, projection, place, status, error) of a rebuild: every projection that an event's category matches, applied or failed. failures: event_id, projection, error."""
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("projection"), F.array(*map(F.lit, of)).alias("of")) for i, (name, of) in enumerate(PROJECTIONS.items())])
    each = rows.select("event_id", F.explode(F.filter(pairs, lambda p: F.array_contains(p["of"], F.col("category")))).alias("p")).select("event_id", "p.projection", "p.place")
    each = each.join(failures, ["event_id", "projection"], "left") if failures is not None else each.withColumn("error", F.lit(None).cast("string"))
    return each.select("event_id", "projection", "place", F.when(F.col("error").isNull(), F.lit("Applied")).otherwise(F.lit("Failed")).alias("status"), "error")


def curation_list(curations: DataFrame, limit: int) -> DataFrame:
    """Newest curations with names for codes and a reverted flag."""
    name = F.element_at(F.array(*map(F.lit, S.CURATIONS)), F.col("kind") + 1)
    return curations.orderBy(F.col("occurred_at").desc(), "curation_id").limit(limit).select("curation_id", "target_id", name.alias("kind"), "curator", "occurred_at", "reverted")


def weight_of(weights: DataFrame, ids: DataFrame) -> DataFrame:
    """(event_id, weight) of some events; 1.0 where feedback has not moved it."""
    return ids.select("event_id").distinct().join(weights.select("event_id", "weight"), "event_id", "left").select("event_id", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def recent_events(log: DataFrame, revocations: DataFrame, limit: int, workstream: str | None = None) -> DataFrame:
    """Newest events with names for codes and a revocation flag."""
    rows = log.where(F.col("workstream_id") == workstream) if workstream else log
    rows = rows.orderBy(F.col("created_at").desc(), "event_id").limit(limit).join(revocations, "event_id", "left")
    name = lambda names, c: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1)
    return rows.select("event_id", "workstream_id", name(S.CATEGORIES, "category").alias("category"), name(S.CLASSIFICATIONS, "classification").alias("classification"), "created_at", F.col("revoked_at").isNotNull().alias("revoked"))


def projection_page(tables: dict[str, DataFrame], name: str, limit: int) -> DataFrame:
    """one of four projections in common columns."""
    if name not in ("facts", "decisions", "goals", "hypotheses"):
        raise ValueError(f"not a projection page: {name}")
    return tables[name].select(F.lit(name).alias("projection"), "workstream_id", "event_id", "statement", "valid_at", F.col("revoked_at").isNotNull().alias("revoked")).orderBy(F.col("valid_at").desc(), "event_id").limit(limit)


def explained(candidates: DataFrame, dispatcher: str) -> DataFrame:
    """one row: the dispatcher, how many candidates were considered, kept and gated out."""
    return candidates.agg(F.lit(dispatcher).alias("dispatcher"), F.count("*").alias("considered"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("gated"))


def participants(config: DataFrame) -> DataFrame:
    """Workstreams that opted in, in order."""
    return config.where("opted_in").select("workstream_id").distinct().orderBy("workstream_id")
