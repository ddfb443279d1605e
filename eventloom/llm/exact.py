"""Exact dedup (operator 2): two Bloom passes find the hashes that may repeat; only their rows shuffle.

Pass one counts rows by slot of the text hash (a slot number and a count move, summed on the map side;
no digest, id or text). Slots that two or more rows fall on become broadcast bitmaps. In pass two a row
whose slot is set may be repeated: its digest and id go to the grouping by digest. All other rows are
certainly unique and pass straight through. Once the corpus outgrows the filter (``MOST_BITS``), more
rows go to the grouping, as digest and id; results stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmaps, cut, filter_bits, fresh, marked, table, without

#: Bits of the filter for each row.
EACH = 32


def slot_of(body: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(body), F.lit(bits))


def exact_groups(df: DataFrame, text: str = "text", key: str = "doc_id", normalise=None, bits: int | None = None) -> DataFrame:
    """Every row of df with keep_id, group_size, kept and text_sha256; of equal texts the row with the largest key stays.

    normalise maps the text column before it is compared (default: no change). Null counts as empty.
    df's own columns all stay; result columns that would clash with one of them get a leading underscore.
    ``bits`` of the filter default to 32 for each row, within the bound of all filters. A null key is
    never kept before a real one; rows that repeat the kept key are all kept. Texts of any length are
    compared by SHA-256. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    body = normalise(body) if normalise else body
    sha, keep, size, kept = fresh(df, "text_sha256", "keep_id", "group_size", "kept")
    may, sha_, keep_, size_ = fresh(df, "may_repeat", "g_sha", "g_keep", "g_size")
    bits = filter_bits(df.count(), EACH) if bits is None else bits
    repeated = df.select(slot_of(body, bits).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    both = marked(df, cut(bitmaps(repeated.select("slot"))), [slot_of(body, bits)], may).withColumn(sha, F.sha2(body, 256))
    maybe = both.where(F.col(may)).drop(may)
    groups = maybe.groupBy(sha).agg(F.max(key).alias(keep_), F.count("*").alias(size_)).where(F.col(size_) > 1).withColumnRenamed(sha, sha_)
    unique = both.where(~F.col(may)).drop(may).withColumn(keep, F.col(key)).withColumn(size, F.lit(1).cast("long")).withColumn(kept, F.lit(True))
    # the groups are written first: then both sides of the join have plain exchanges, and a hot digest can be split
    maybe = maybe.join(cut(groups), F.col(sha) == F.col(sha_), "left")
    maybe = maybe.withColumn(keep, F.when(F.col(sha_).isNull(), F.col(key)).otherwise(F.col(keep_))).withColumn(size, F.coalesce(F.col(size_), F.lit(1)).cast("long"))
    maybe = maybe.withColumn(kept, F.col(key).eqNullSafe(F.col(keep)))
    return unique.unionByName(maybe.select(unique.columns))


def keep_largest(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) without the rows whose text stays in another row; empty and null texts are one text. All columns stay."""
    return without(docs, exact_groups(docs.select("doc_id", "text")).where("not kept").select("doc_id"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""
