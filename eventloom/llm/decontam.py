"""Benchmark decontamination (operator 3): scan token windows against a broadcast hash set of test n-grams.

Benchmark items become windows of ``size`` normalised words (a shorter item is one window). One pass
over all document positions probes a broadcast set of the hashes of the windows' first ``HEAD`` words;
its size is bounded, since hashes are cut to fewer bits when there are more than ``MOST_HEADS``. A
position that hits goes on with the words of its window alone, never with its document, and is verified
word by word in a join with the windows, which Spark broadcasts or shuffles by their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, folded, pieces, table, without

#: Characters that separate words, once A-Z is lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Words of a window that its hash covers.
HEAD = 4
#: Positions of a document that are scanned at once; a chunk goes on for the words of a window beyond them, so rows stay small in the longest text.
CHUNK = 512
#: Different heads that the broadcast set holds at most (8 bytes each); of more windows, hashes modulo this number are held.
MOST_HEADS = 1 << 22
#: Windows are broadcast as a whole up to so many bytes of their words and items.
MOST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return pieces(folded(text), SEPARATORS)


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(gram, m, items): the distinct windows of all items and the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("w")).where("size(w) > 0")
    m = F.least(F.size("w"), F.lit(size))
    grams = items.select("item", m.alias("m"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.slice("w", i, m))).alias("gram"))
    return grams.groupBy("gram").agg(F.first("m").alias("m"), F.collect_set("item").alias("items"))


def head_hash(array: str, first: Column, n: int, modulus: int | None) -> Column:
    h = F.xxhash64(F.lit(n), *[F.get(F.col(array), first + (j - 1)) for j in range(n)])
    return F.pmod(h, F.lit(modulus)) if modulus else h


def hits(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """(doc_id, at, m, items): every place where a window occurs; ``at`` counts words from 1."""
    grams = cut(windows(benchmark, size))
    weight = F.sum(F.octet_length(F.array_join("gram", " ")) + 24 * F.col("m") + F.octet_length(F.array_join("items", " ")) + 24 * F.size("items"))
    lengths, many, weight = grams.agg(F.sort_array(F.collect_set("m")), F.count("*"), weight).first()  # at most ``size`` lengths
    grams = F.broadcast(grams) if (weight or 0) <= MOST_BYTES else grams
    modulus = MOST_HEADS if many > MOST_HEADS else None
    scan = docs.select("doc_id", words(F.col("text")).alias("w"))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(CHUNK)), lambda b: F.struct(b.alias("base"), F.slice("w", b + 1, CHUNK + size - 1).alias("w")))
    scan = scan.select("doc_id", F.explode(chunks).alias("c")).select("doc_id", "c.base", "c.w").where("size(w) > 0")
    scan = scan.select("doc_id", "base", "w", F.explode(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(CHUNK)))).alias("at"))
    found = []
    for n in sorted({min(m, HEAD) for m in lengths}):
        own = [m for m in lengths if min(m, HEAD) == n]
        heads = grams.where(F.col("m").isin(own)).select(head_hash("gram", F.lit(1), n, modulus).alias("head")).distinct()
        near = scan.join(F.broadcast(heads), head_hash("w", F.col("at"), n, modulus) == F.col("head"), "left_semi")
        lists = F.transform(F.array(*map(F.lit, own)), lambda m: F.when(F.col("at") + m - 1 <= F.size("w"), F.slice("w", F.col("at"), m)))
        near = near.select("doc_id", (F.col("base") + F.col("at")).alias("place"), F.explode(lists).alias("gram"))
        found.append(near.where("gram is not null").join(grams, "gram").select("doc_id", F.col("place").alias("at"), "m", "items"))
    none = docs.select("doc_id", F.lit(1).alias("at"), F.lit(1).alias("m"), F.array(F.lit("")).alias("items")).where(F.lit(False))
    return reduce(DataFrame.union, found, none)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, percent: int = 5) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, places (hit word numbers), items, contaminated.

    docs: doc_id (unique, not null) and text; benchmark: item_id and text; other columns are ignored.
    A word is hit if an occurrence of a window covers it. A document is contaminated with at least one
    hit word and ``percent`` of its words hit. Null, empty and wordless texts have no words and no
    hits; such items have no window. Empty tables give no rows, or no hits. Texts may have any length;
    a row that repeats a doc_id with its text gets the same result once more.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    by = hits(docs, benchmark, size).groupBy("doc_id").agg(F.collect_set(F.struct("at", "m")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["m"] - 1))))
    by = by.select("doc_id", places.alias("places"), "items")
    all_ = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(by, "doc_id", "left")
    n_hit = F.coalesce(F.size("places"), F.lit(0)).cast("long")
    return all_.select("doc_id", "n_words", n_hit.alias("n_hit"), "places", F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents."""
    return without(docs, contamination(docs, benchmark).where("contaminated").select("doc_id"))


def without_hit_words(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text) with every hit word removed, together with the separators after it; the rest is unchanged."""
    marked = contamination(docs, benchmark).select("doc_id", "places")
    both = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(marked, "doc_id")
    part = F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", 0)
    left = F.array_except(F.sequence(F.lit(1), F.size("parts")), F.col("places"))
    kept = F.concat(lead, F.array_join(F.transform(left, lambda i: F.element_at("parts", i)), ""))
    return both.withColumn("parts", part).select("doc_id", F.when(F.col("places").isNull(), F.col("text")).otherwise(kept).alias("text"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array("items"), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM g),
p AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, m WHERE len(w) >= m),
h AS (SELECT p.doc_id, p.i, p.m, g.item_id FROM p JOIN g ON g.m = p.m AND g.gram = array_to_string(p.w[p.i:p.i + p.m - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
