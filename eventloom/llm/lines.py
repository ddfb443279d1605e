"""Line dedup (operator 4): levelled sorted runs of line hashes, compacted periodically.

A run is a table of (h1, h2, n): a 128-bit hash of a line's key and the number of documents that hold
it, bucketed and sorted by hash. Documents come in batches. A batch's counts are merge-anti-joined with
the runs of settled keys (those that have reached the threshold already) and added as a run of level 0.
When a level has two runs they merge into one run of the next level, and keys that reach the threshold
move to a settled run. At the end the levels merge once more. Runs are bucketed alike, so a
merge or anti-join reads them bucket by bucket, without an exchange; only a batch's own counts shuffle.
Open keys are counted on, not anti-joined: a key that is not settled may still become frequent.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, folded, shared_folder, table, with_side

#: ASCII white space that is stripped from both ends of a line.
EDGE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return folded(F.trim(line, F.lit(EDGE)))


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(71), key).alias("h2"))


class LineRuns:
    """Levelled runs of line hashes: bucketed tables whose files lie in the shared folder."""

    def __init__(self, spark: SparkSession, least: int, folder: str | None = None, buckets: int | None = None):
        self.spark, self.least = spark, least
        self.folder = folder or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []
        self._tables: list[str] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self._tables.append(name)
        return name

    def fresh_lines(self, lines: DataFrame) -> DataFrame:
        """Lines (h1, h2, ...) whose keys are not settled yet; each settled run joins by its buckets."""
        for name in self.settled:
            lines = lines.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Add a batch: one row (h1, h2) for each key of each document."""
        counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"))
        self.levels[0].append(self._write(self.fresh_lines(counts)))
        level = 0
        while len(self.levels[level]) > 1:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.merged(*self.levels[level]))
            self.levels[level] = []
            level += 1

    def merged(self, one: str, two: str) -> str:
        """One open run for two; what reaches the threshold becomes a settled run."""
        a, b = self.spark.table(one).withColumnRenamed("n", "n1"), self.spark.table(two).withColumnRenamed("n", "n2")
        both = a.join(b, ["h1", "h2"], "full_outer").select("h1", "h2", (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).cast("long").alias("n"))
        return self.split(self._write(both))

    def split(self, name: str) -> str:
        run = self.spark.table(name)
        self.settled.append(self._write(run.where(F.col("n") >= self.least)))
        return self._write(run.where(F.col("n") < self.least))

    def frequent(self) -> DataFrame:
        """(h1, h2) of every key in at least ``least`` documents."""
        open_ = [name for level in self.levels for name in level]
        while len(open_) > 1:
            open_ = [self.merged(*open_[:2]), *open_[2:]]
        if open_ and not self.settled:
            open_ = [self.split(open_[0])]
        self.levels = [open_]
        settled = [self.spark.read.schema("h1 long, h2 long, n long").parquet(f"{self.folder}/{name}") for name in self.settled]
        return reduce(DataFrame.unionByName, settled).select("h1", "h2").distinct()

    def drop(self) -> None:
        """Forget the tables; their files go with the shared folder of the application."""
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_frequent_lines(docs: DataFrame, least: int = 10, shortest: int = 1, batches: int = 4) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and kept_text, without the lines whose key at least ``least`` documents hold.

    docs: doc_id long (not null) and text; other columns are ignored. A key is the line stripped of
    ASCII white space with A-Z lower-cased; keys of fewer than ``shortest`` code points always stay.
    Null and empty texts are one empty line; texts may have any length and number of lines. A row that
    repeats a doc_id with its text counts as one more document and gets the same result. An empty table
    gives no rows. ``batches`` only says in how many steps the runs are built; the result does not
    depend on it. Texts are split once for their hashes, which are written; texts without a frequent
    line pass straight through.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key_hash = lambda x: F.when(F.length(line_key(x)) >= shortest, hashes(line_key(x)))
    lines = cut(docs.select("doc_id", F.transform(split_lines(F.col("text")), key_hash).alias("keys")))
    runs = LineRuns(spark, least)
    for i in range(batches):
        batch = lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i)
        runs.add(batch.select(F.explode(F.array_distinct("keys")).alias("k")).where("k is not null").select("k.*"))
    frequent = cut(runs.frequent())
    runs.drop()
    at = lines.select("doc_id", F.posexplode("keys").alias("at", "k")).where("k is not null").select("doc_id", "at", "k.h1", "k.h2")
    hit = cut(at.join(frequent, ["h1", "h2"]).groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("hit")))
    out = with_side(docs, hit).withColumn("lines", split_lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("hit"))
    text = F.when(F.col("hit").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n"))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("kept_text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE key IN (SELECT key FROM f)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
