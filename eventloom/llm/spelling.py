"""Spelling variant grouping (operator 11): words that differ by one code point, found by rolling-hash deletions.

Prefix and suffix sums of a polynomial hash give, in NumPy and for many words at once, the hash of each
word without its i-th code point. Two words that differ by a replacement share (i, what is left); a word
and a longer one with an insertion share the longer one's rest, which is the shorter word itself. So
each word gives a key for each position, a key for each distinct rest, and a key for itself. Keys are
64-bit numbers: Spark deals them out and sorts them, and keys that occur once go. Only words that share
a key meet again as strings: what is left is cut from the word itself, and classes are formed by these
strings, so that a collision of hashes makes no link.

No pairs are made. In a class of replacements each word is near to all others, so their number and the
two most frequent words say everything; in a class of insertions the short word is near to all others
and they only to it. A class is bounded by the alphabet and the word's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut, folded, schema, table
from .hashing import U, mix, powers
from .manifest import CRC, CRC_TABLE

RUN = "[A-Za-zÀ-ÿ]+"
_BASE = 0x9FB21C651E98DF25
#: Keys of one word that a task sends at once; longer words go in several batches.
KEYS = 1 << 17
#: How often a run is damaged: one in so many, by its checksum.
DAMAGE = 97


def deletion_keys(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word number, position, key) in steps: position -1 for the word itself, p for what is left without p, -2 - p for the same without its place.

    Of equal neighbours only the first is left out for the keys without a place, since the rest is the same.
    """
    text = "".join(words.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    p, inverse = powers(_BASE, len(points) + 1)
    total = np.zeros(len(points) + 1, U)
    np.cumsum(mix(points.astype(U) + U(1)) * p[: len(points)], dtype=U, out=total[1:])
    yield np.arange(len(size)), np.full(len(size), -1), mix((total[end] - total[start]) * inverse[start])
    for a in range(0, len(points), KEYS):
        at = np.arange(a, min(a + KEYS, len(points)))
        word = np.searchsorted(end, at, side="right")
        s, e, place = start[word], end[word], at - start[word]
        rest = mix((total[at] - total[s]) * inverse[s] + (total[e] - total[at + 1]) * inverse[np.minimum(s + 1, len(points))])
        yield word, place, mix(rest + (place.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
        opens = (place == 0) | (points[at] != points[np.maximum(at - 1, 0)])
        yield word[opens], -2 - place[opens], rest[opens]


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column("id").to_numpy()
        for word, place, key in deletion_keys(batch.column("word")):
            yield pa.RecordBatch.from_arrays([pa.array(ids[word], pa.int64()), pa.array(place, pa.int32()), pa.array(key.view(np.int64), pa.int64())], names=["id", "place", "key"])


def damaged(key: Column, run: Column) -> Column:
    """A lower-cased run, or without one code point where the checksum of key and run says so."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words_of(docs: DataFrame, least_length: int = 5, least_count: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): damaged, lower-cased runs of letters of all texts (null: none), of so many code points and occurrences.

    A null key counts as an empty one. Counts are summed on the map side before words shuffle.
    """
    runs = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(folded(F.col(text).cast("string")), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= least_length).select(damaged(F.col("key"), F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def near_words(words: DataFrame) -> DataFrame:
    """Of the words (word, n) those that have near ones: (word, n_near, near, near_n), with the most frequent near word (ties: the smallest in code-point order)."""
    arrow_batches(words.sparkSession)
    words = words.withColumn("id", F.xxhash64("word"))
    keys = words.select("id", "word").mapInArrow(keyed, schema("id long, place int, key long"))
    shared = cut(keys.withColumn("sharing", F.count("*").over(Window.partitionBy("key"))).where("sharing > 1").drop("sharing", "key"))
    place = F.when(F.col("place") < -1, -2 - F.col("place")).otherwise(F.col("place"))
    rest = F.when(F.col("place") == -1, F.col("word")).otherwise(F.concat(F.substring(F.col("word"), F.lit(1), place), F.substring(F.col("word"), place + 2, F.length("word"))))
    rows = shared.join(words, "id").select("word", "n", (F.col("place") == -1).alias("whole"), F.greatest("place", F.lit(-1)).alias("place"), rest.alias("rest"))
    rows = rows.repartition("place", "rest").distinct()  # words whose ids collide have met each other's rows
    group = Window.partitionBy("place", "rest")
    best = F.struct((-F.col("n")).alias("less"), F.col("word").alias("near"))
    among = group.orderBy("less", "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("less", -F.col("n")).withColumn("many", F.count("*").over(group)).where("many > 1")
    first, second = F.first(best).over(among), F.nth_value(best, 2).over(among)
    replaced = rows.where("place >= 0").select("word", (F.col("many") - 1).alias("links"), F.when(first["near"] == F.col("word"), second).otherwise(first).alias("best"))
    whole, longer = F.min(F.when(F.col("whole"), best)).over(group), F.min(F.when(~F.col("whole"), best)).over(group)
    inserted = rows.where("place = -1").select("word", F.when(F.col("whole"), F.col("many") - 1).otherwise(F.when(whole.isNotNull(), 1).otherwise(0)).alias("links"), F.when(F.col("whole"), longer).otherwise(whole).alias("best"))
    out = replaced.unionByName(inserted).where("links > 0").groupBy("word").agg(F.sum("links").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), each form more frequent than its word: every round jumps twice as far."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = cut(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of docs (doc_id, text).

    A word's form is its most frequent near word, where that is at least ``times`` as frequent; roots
    follow forms to the last. ``times`` must be above 1, so that forms never lead back. Null and empty
    texts have no words; texts and words may have any length; repeated rows count each; other columns
    are ignored whatever their names. No words give no rows.
    """
    words = cut(words_of(docs, least_length, least_count))
    out = words.join(near_words(words), "word", "left")
    is_form = F.col("near_n") >= times * F.col("n")
    out = cut(out.select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n")))
    out = out.join(roots_of(out.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


_UTF8 = "flatten(list_transform(string_split({s}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))"

OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (
    SELECT doc_id, run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, n, {CRC.format(bytes=_UTF8.format(s="concat(doc_id, ':', run)"))} AS h FROM r, crc),
w AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT n, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, p, word[:p - 1] || word[p + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
e AS (
    SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM k AS a JOIN k AS b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.rest = w.word
    UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.rest = w.word),
o AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM e GROUP BY word),
f AS (
    SELECT word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
    FROM w LEFT JOIN o USING (word)),
t AS (SELECT word, word AS at FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word JOIN f AS last ON last.word = t.at WHERE last.form IS NULL
"""
