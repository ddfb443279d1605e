"""Subjects by substring (J7, F11), and nearest vectors (S6, T4), without a look at every row.

A subject matches a key of the question if it contains it or lies in it. Subjects that contain a key are found by
trigrams: a table of trigrams of the different subject keys gives those that have all of the key's, which are
then compared. Subjects that lie in a key are its own substrings, a bounded list that is looked up. Triples
are read last, by the keys found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as R
from ..sources.versioned import Versioned, bucket_of, bucket_on_driver

TRIPLE = "workstream_id string, event_id string, ordinal int, subject_key string, predicate string, object string, valid_at timestamp_ntz"
#: Length of the pieces of a subject key that the table has; keys of the question that are shorter are looked for in all subject keys.
GRAM = 3
#: Longest subject key that a question's key may hold; longer parts of a question are not names.
LONGEST = 200


def grams(key: Column) -> Column:
    """Different pieces of GRAM code points; a shorter key is its own piece."""
    n = F.length(key)
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(GRAM)))
    return F.array_distinct(all_)


class SubjectIndex:
    """Triples by subject key, and the pieces of the different subject keys."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.triples = Versioned(spark, f"{folder}/triples", TRIPLE, "subject_key", buckets, order=["subject_key"], page_rows=1000)
        self.grams = Versioned(spark, f"{folder}/grams", "gram string, subject_key string", "gram", buckets, order=["gram"], page_rows=1000)

    def add(self, triples: DataFrame, batch: int | None = None) -> None:
        """More triples; keys that are new get their pieces. A batch is added once."""
        before = self.triples.before(batch) if batch is not None else self.triples.last()
        new = triples.select("subject_key").distinct()
        some = [r[0] for r in new.select(bucket_of(F.col("subject_key"), self.triples.buckets)).distinct().collect()]
        fresh = new.join(self.triples.read(some, before).select("subject_key").distinct(), "subject_key", "left_anti")
        self.grams.append(fresh.select(F.explode(grams(F.col("subject_key"))).alias("gram"), "subject_key"), batch)
        self.triples.append(triples, batch)

    def keys(self, wanted: list[str]) -> DataFrame:
        """(subject_key) of all subjects that contain one of a question's few keys or lie in one."""
        wanted = sorted({k for k in wanted if k})
        found = self.triples.spark.createDataFrame([], "subject_key string")
        inside = sorted({k[i:j] for k in wanted for i in range(len(k)) for j in range(i, min(len(k), i + LONGEST) + 1)})
        for k in wanted:
            if len(k) < GRAM:
                containing = self.grams.read().where(F.contains("subject_key", F.lit(k)))
            else:
                pieces = sorted({k[i : i + GRAM] for i in range(len(k) - GRAM + 1)})
                containing = self.grams.of_keys(pieces).groupBy("subject_key").agg(F.count_distinct("gram").alias("n")).where((F.col("n") == len(pieces)) & F.contains("subject_key", F.lit(k)))
            found = found.union(containing.select("subject_key"))
        return found.union(self._among(inside)).distinct()

    def _among(self, keys: list[str]) -> DataFrame:
        own = self.triples.spark.createDataFrame([(k,) for k in keys], "subject_key string")
        rows = self.triples.read({bucket_on_driver(k, self.triples.buckets) for k in keys})
        return rows.select("subject_key").join(F.broadcast(own), "subject_key", "left_semi")  # the question bounds the keys

    def match(self, wanted: list[str]) -> DataFrame:
        """The triples of these subjects; only their buckets are opened."""
        keys = [r[0] for r in self.keys(wanted).limit(MOST_KEYS + 1).collect()]
        if len(keys) <= MOST_KEYS:
            return self.triples.of_keys(keys)
        return self.triples.read().join(self.keys(wanted), "subject_key", "left_semi").select(*self.triples.read([]).columns)


#: Subject keys that are read by name; a question that matches more joins the triples.
MOST_KEYS = 2000


@dataclass(frozen=True)
class Cluster:
    """A centre of length one, and the widest angle to it among its vectors."""

    centre: np.ndarray
    angle: float
    n: int


class VectorIndex:
    """Vectors in clusters with centre and widest angle, visited best bound first: exact top-k without scoring all.

    Centres are a sample of the vectors; each vector joins the nearest. By the triangle inequality of
    angles no vector of a cluster is nearer to the query than the query's angle to the centre less the
    cluster's widest. How much that saves depends on how clustered the vectors are; ``scored`` says it.
    """

    def __init__(self, vectors: DataFrame, key: str, clusters: int, folder: str):
        spark = vectors.sparkSession
        self.key, self.table = key, Versioned(spark, folder, f"cluster string, {key} {vectors.schema[key].dataType.simpleString()}, unit array<double>", "cluster", clusters, order=["cluster", key])
        norm = F.sqrt(R.dot(F.col("embedding"), F.col("embedding")))
        unit = F.transform("embedding", lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))
        rows = vectors.select(key, unit.alias("unit"))
        centres = [np.array(r["unit"]) for r in rows.where(R.dot(F.col("unit"), F.col("unit")) > 0.5).orderBy(F.xxhash64(key), key).limit(clusters).collect()]
        one = spark.createDataFrame([([(str(i), c.tolist()) for i, c in enumerate(centres)],)], "centres array<struct<c:string,v:array<double>>>")
        best = F.array_max(F.transform("centres", lambda t: F.struct(R.dot(t["v"], F.col("unit")).alias("s"), t["c"].alias("c"))))
        placed = rows.crossJoin(F.broadcast(one)).withColumn("best", best).drop("centres").withColumn("cluster", F.coalesce("best.c", F.lit("0")))
        self.table.append(placed.select("cluster", key, "unit"))
        wide = placed.groupBy("cluster").agg(F.min(F.coalesce("best.s", F.lit(0.0))).alias("s"), F.count("*").alias("n")).collect()
        self.clusters = {r["cluster"]: Cluster(centres[int(r["cluster"])] if centres else np.zeros(1), float(np.arccos(np.clip(r["s"], -1, 1))), r["n"]) for r in wide}
        self.scored = 0

    def topk(self, query: list[float], limit: int) -> list[tuple]:
        """[(key, cosine)] of the nearest vectors, cosine clamped to [0, 1]; ties by key."""
        q = np.array(query, float)
        q = q / max(np.linalg.norm(q), 1e-300)
        bound = {c: min(1.0, max(0.0, float(np.cos(max(0.0, np.arccos(np.clip(x.centre @ q, -1, 1)) - x.angle))) + 1e-9)) for c, x in self.clusters.items()}
        order, at, best, self.scored = sorted(bound, key=lambda c: (-bound[c], c)), 0, [], 0
        while at < len(order) and (len(best) < limit or bound[order[at]] >= best[-1][1]):
            n, upto = 0, at
            while upto < len(order) and (n < limit or upto - at < VISITED) and (len(best) < limit or bound[order[upto]] >= best[-1][1]):
                n, upto = n + self.clusters[order[upto]].n, upto + 1
            best = self._best(order[at:upto], q, limit, best)
            self.scored, at = self.scored + n, upto
        return best

    def _best(self, clusters: list[str], q: np.ndarray, limit: int, had: list[tuple]) -> list[tuple]:
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), R.dot(F.col("unit"), F.array(*map(F.lit, q.tolist())))))
        rows = self.table.of_keys(clusters).select(self.key, score.alias("s")).orderBy(F.desc("s"), self.key).limit(limit).collect()
        return sorted([*had, *((r[0], r[1]) for r in rows)], key=lambda x: (-x[1], x[0]))[:limit]


#: Clusters that are visited at once at least.
VISITED = 8
