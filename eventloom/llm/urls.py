"""URL filters (operator 8): a temporal join of captures with dated list entries.

A list is a log of dated events: an entry is added or removed on a day. Each add opens a validity
interval that the entry's next event closes. A capture is looked up by its host and every parent domain
of at least two labels, alone and with every leading part of its path, against the entries whose
interval holds its fetch day. A host of digits and dots is an address and has no parents.

Only what the list can hold is looked up: parents of as many labels as some entry's domain has, and of
the path as many parts as entries of this very domain have. So the work for a URL grows with its length
and the list's different depths, not with the product of its labels and parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, table, with_side

#: Scheme, user information, host without port or final dot, path.
URL = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*[^/:?#.])\.?(?::[0-9]*)?(/[^?#]*)?"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), URL, 1)


def path_of(url: Column) -> Column:
    """The path's parts, each after one slash; empty where there are none."""
    parts = F.filter(F.split(F.regexp_extract(F.lower(url), URL, 2), "/"), lambda p: p != "")
    return F.when(F.size(parts) == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


def keys_of(url: Column) -> Column:
    """All that entries may name this URL by: domains, and domains with leading parts of the path; empty for null and hostless URLs. Makes a list of ordinary URLs; captures are not looked up by it."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    most = F.when(F.regexp_like(host, F.lit(r"^[0-9.]+$")), F.lit(1)).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))
    domains = F.transform(F.sequence(F.lit(1), most), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(F.lower(url), URL, 2), "/"), lambda p: p != "")
    paths = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    with_paths = F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.concat(d, p))))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, with_paths)))


def intervals(events: DataFrame) -> DataFrame:
    """(entry, valid_from, valid_to): the days from valid_from up to before valid_to (null: open) that each entry is active.

    events: entry, day, action ('add' or 'remove'). Rows with a null are ignored. Of events of an entry
    on one day an add outlasts a remove; repeated rows count once. Entries are lower-cased and lose a
    final slash.
    """
    events = events.select(F.regexp_replace(F.lower("entry"), "/+$", "").alias("entry"), "day", "action")
    daily = events.where("entry is not null and day is not null and action in ('add', 'remove')").groupBy("entry", "day").agg(F.min("action").alias("action"))
    following = F.lead("day").over(W.partitionBy("entry").orderBy("day"))
    return daily.select("entry", "action", F.col("day").alias("valid_from"), following.alias("valid_to")).where("action = 'add'").drop("action")


def listed(captures: DataFrame, events: DataFrame, url: str = "url", day: str = "fetched", key: str = "page_id") -> DataFrame:
    """Every capture with n_entries (entries active on its day), first_entry (the least of them) and blocked.

    A capture with a null URL, host, day or key matches nothing. Rows that repeat a key share what any of
    them matches. Empty lists block nothing, empty captures give no rows; URLs may have any length.
    captures' columns all stay; a result column that would clash gets an underscore. Intervals are
    written before they meet the captures, so that the join can split a popular domain. Only captures
    that may have an entry meet what was found; all others pass straight through with all their columns.
    """
    count, first, blocked, cid = fresh(captures, "n_entries", "first_entry", "blocked", "cid")
    active = cut(intervals(events))
    named = active.select("entry", F.substring_index("entry", "/", 1).alias("domain"), (F.size(F.split("entry", "/")) - 1).alias("depth"))
    depths = cut(named.groupBy("domain").agg(F.collect_set("depth").alias("depths")))
    labels = depths.agg(F.collect_set(F.size(F.split("domain", r"\."))).alias("labels"))
    looked = captures.select(F.col(key).alias(cid), F.col(day).alias("on"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).where("host <> '' and on is not null")
    looked = looked.crossJoin(F.broadcast(labels))  # one row
    most = F.size(F.split("host", r"\."))
    parents = F.filter("labels", lambda n: (n == most) | ((n > 1) & (n < most) & ~F.regexp_like(F.col("host"), F.lit(r"^[0-9.]+$"))))
    looked = looked.select(cid, "on", "path", F.explode(F.transform(parents, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))).alias("domain"))
    looked = looked.join(depths, "domain").select(cid, "on", "domain", "path", F.explode(F.filter("depths", lambda d: d <= F.size(F.split("path", "/")) - 1)).alias("depth"))
    looked = looked.select(cid, "on", F.concat("domain", F.call_function("substring_index", F.col("path"), F.lit("/"), F.col("depth") + 1)).alias("entry"))
    hit = looked.join(active, "entry").where("on >= valid_from and (valid_to is null or on < valid_to)")
    found = cut(hit.groupBy(F.col(cid).alias(key)).agg(F.countDistinct("entry").alias(count), F.min("entry").alias(first)))
    out = with_side(captures, found, key)
    return out.withColumn(count, F.coalesce(F.col(count), F.lit(0)).cast("long")).withColumn(blocked, F.col(count) > 0)


def dated_list(pages: DataFrame) -> DataFrame:
    """A stand-in list with a rule of its own: one key in sixteen of those that occur, with days taken from its hash."""
    m = F.md5("entry")
    n = lambda at, length: F.conv(F.substring(m, at, length), 16, 10).cast("int")
    start = n(2, 2)
    keys = pages.select(F.explode(keys_of(F.col("url"))).alias("entry")).distinct().where(F.substring(m, 1, 1) == "0")
    rows = keys.select("entry", F.explode(F.array(F.struct(start.alias("at"), F.lit("add").alias("action")), F.struct((start + 1 + n(4, 2) % 90).alias("at"), F.lit("remove").alias("action")), F.struct(F.when(n(6, 1) < 8, start + 120).alias("at"), F.lit("add").alias("action")))).alias("e"))
    return rows.where("e.at is not null").select("entry", F.date_add(F.lit("2024-01-01").cast("date"), F.col("e.at")).alias("day"), "e.action")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return listed(captures, dated_list(pages)).select("page_id", F.col("fetched").cast("string").alias("fetched"), "n_entries", "first_entry", "blocked")


OP8_SQL = r"""
WITH u AS (SELECT page_id, lower(url) AS url, CAST(page_id % 366 AS INTEGER) AS d FROM pages),
h AS (SELECT *, regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*[^/:?#.])\.?(?::[0-9]*)?(/[^?#]*)?', 1) AS host,
        list_filter(string_split(regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*[^/:?#.])\.?(?::[0-9]*)?(/[^?#]*)?', 2), '/'), lambda x: x <> '') AS parts FROM u),
l AS (SELECT *, string_split(host, '.') AS labels FROM h WHERE coalesce(host, '') <> ''),
o AS (SELECT page_id, d, parts, array_to_string(labels[i:len(labels)], '.') AS domain
      FROM (SELECT *, unnest(range(1, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN 1 ELSE greatest(len(labels) - 1, 1) END + 1)) AS i FROM l)),
k AS (SELECT DISTINCT page_id, d, entry FROM (
        SELECT page_id, d, domain AS entry FROM o
        UNION ALL SELECT page_id, d, domain || '/' || array_to_string(parts[1:j], '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM o))),
e AS (SELECT entry, md5(entry) AS m FROM (SELECT DISTINCT entry FROM k) WHERE md5(entry)[1] = '0'),
n AS (SELECT entry, CAST(('0x' || m[2:3]) AS INTEGER) AS s, CAST(('0x' || m[4:5]) AS INTEGER) AS g, CAST(('0x' || m[6]) AS INTEGER) AS r FROM e),
v AS (SELECT entry, s AS day, 'add' AS action FROM n UNION ALL SELECT entry, s + 1 + g % 90, 'remove' FROM n UNION ALL SELECT entry, s + 120, 'add' FROM n WHERE r < 8),
w AS (SELECT entry, action, day AS f, lead(day) OVER (PARTITION BY entry ORDER BY day) AS t FROM (SELECT entry, day, min(action) AS action FROM v GROUP BY entry, day)),
a AS (SELECT page_id, count(DISTINCT entry) AS c, min(entry) AS first_entry FROM k JOIN w USING (entry) WHERE action = 'add' AND d >= f AND (t IS NULL OR d < t) GROUP BY page_id)
SELECT u.page_id, CAST(DATE '2024-01-01' + u.d AS VARCHAR) AS fetched, CAST(coalesce(c, 0) AS BIGINT) AS n_entries, first_entry, coalesce(c, 0) > 0 AS blocked
FROM u LEFT JOIN a USING (page_id)
"""
