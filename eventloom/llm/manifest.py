"""Merkle dataset manifest (operator 13): every row is a leaf, groups have trees, and a tree over the groups gives one root.

Leaves are hashed once and written, sorted by ranges of (group, key), and numbered within their
partition. The numbers of rows by partition and group give the offset that turns such a number into a
rank; only the first group of a partition can have one, so the table of offsets has a row a partition
at most. Tasks then read runs of consecutive ranks and build all complete aligned subtrees inside a
block of 3**BAND ranks at once, with each leaf's siblings below the subtree's top. Only the tops go
on: ragged ones meet by the coordinate of their block, whole blocks by that of the block above, a band
of levels at a time. Paths come back down as left and right neighbours for each level, so that proofs
and folded roots are plain column expressions.

However a task's rows were cut, tops and paths are right: a broken run only makes more tops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut, few, fresh, schema, table

FANOUT = 3
#: Levels that one task builds at once: 3**7 leaves or nodes.
BAND = 7
STEP = pa.struct([("l", pa.string()), ("r", pa.string())])
PATH = "array<struct<l: string, r: string>>"
#: Rows that a task gathers before it sends a batch on.
SEND = 2000


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition with ``place``, their number within their group."""
    last, seen = None, 0
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        g = batch.column("g")
        start = np.flatnonzero(np.r_[True, ~pc.equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)])
        size = np.diff(np.r_[start, n])
        place = np.arange(n) - np.repeat(start, size)
        if g[0].as_py() == last:
            place[: size[0]] += seen
        last, seen = g[n - 1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def subtree(leaves: list[str], first: int) -> tuple[np.ndarray, np.ndarray, list[str | None], pa.Array]:
    """Complete aligned subtrees over ranks first, first + 1, ... inside one block.

    For each leaf: level and index of its top, the top's digest (on the top's first leaf alone), and the steps up to it.
    """
    m = len(leaves)
    rank, level = np.arange(first, first + m), np.zeros(m, np.int64)
    nodes, low = [leaves], [first]
    while len(low) <= BAND:
        lo, hi, below = -(-low[-1] // FANOUT), (low[-1] + len(nodes[-1])) // FANOUT, nodes[-1]
        if lo >= hi:
            break
        at = FANOUT * lo - low[-1]
        nodes.append([digest(below[k : k + FANOUT]) for k in range(at, at + FANOUT * (hi - lo), FANOUT)])
        low.append(lo)
        span = FANOUT ** (len(low) - 1)
        level[max(0, lo * span - first) : hi * span - first] += 1
    left, right, base = [], [], []
    for h, lo in zip(nodes[:-1], low[:-1], strict=True):
        base.append(len(left))
        for k in range(len(h)):
            p = (lo + k) % FANOUT
            left.append("".join(h[max(0, k - p) : k]))
            right.append("".join(h[k + 1 : k + FANOUT - p]))
    index = rank // FANOUT**level
    heads = np.flatnonzero(np.r_[True, (index[1:] != index[:-1]) | (level[1:] != level[:-1])])
    tops: list[str | None] = [None] * m
    for k in heads.tolist():
        tops[k] = nodes[level[k]][int(index[k]) - low[level[k]]]
    row = np.repeat(np.arange(m), level)
    step = np.arange(len(row)) - np.repeat(np.cumsum(level) - level, level)
    node = np.array(base or [0])[step] + rank[row] // FANOUT**step - np.array(low)[step] if len(row) else np.zeros(0, np.int64)
    steps = pa.StructArray.from_arrays([pa.array(x, pa.string()).take(pa.array(node)) for x in (left, right)], fields=list(STEP))
    return level, index, tops, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(level)], pa.int32()), steps)


def local_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of consecutive ranks with the subtrees that are complete among them."""
    block = FANOUT**BAND
    held: list[pa.RecordBatch] = []
    ready: list[pa.RecordBatch] = []

    def built() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        level, index, tops, path = subtree(rows.column("leaf").to_pylist(), rows.column("rank")[0].as_py())
        more = [pa.array(level, pa.int32()), pa.array(index, pa.int64()), pa.array(tops, pa.string()), path]
        return pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*rows.schema.names, "level", "idx", "top", "path"])

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        g, rank = batch.column("g"), batch.column("rank").to_numpy()
        fresh_run = ~pc.equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (rank[1:] != rank[:-1] + 1) | (rank[1:] % block == 0)
        edges = [0, *(np.flatnonzero(fresh_run) + 1).tolist(), n]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            goes_on = a == 0 and held and held[-1].column("g")[-1].as_py() == g[0].as_py() and held[-1].column("rank")[-1].as_py() + 1 == rank[0] and rank[0] % block
            if held and not goes_on:
                ready.append(built())
                held = []
            held.append(batch.slice(a, b - a))
            if sum(map(len, ready)) >= SEND:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
    if held:
        ready.append(built())
    if ready:
        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()


def climbed(nodes: pa.Table) -> pa.Table:
    """The nodes (level, idx, hash) of one block of one group, up to ``stop``: each node's steps, and the block's top (with its digest)."""
    first = nodes.slice(0, 1).to_pylist()[0]
    have = {(r["level"], r["idx"]): r["hash"] for r in nodes.select(["level", "idx", "hash"]).to_pylist()}
    given, steps = list(have), {}
    level = min(k for k, _ in have)
    width = -(-first["size"] // FANOUT**level)
    while level < first["stop"]:
        for p in sorted({i // FANOUT for k, i in have if k == level}):
            kids = [have[level, i] for i in range(FANOUT * p, min(FANOUT * (p + 1), width))]
            have[level + 1, p] = digest(kids)
            for j in range(len(kids)):
                steps[level, FANOUT * p + j] = {"l": "".join(kids[:j]), "r": "".join(kids[j + 1 :])}
        level, width = level + 1, -(-width // FANOUT)
    out = [(k, i, None, [steps[at, i // FANOUT ** (at - k)] for at in range(k, level)]) for k, i in given]
    out += [(k, i, h, None) for (k, i), h in have.items() if k == level]
    k, i, h, p = zip(*out, strict=True)
    return pa.table({"g": pa.array([first["g"]] * len(k), pa.string()), "level": pa.array(k, pa.int32()), "idx": pa.array(i, pa.int64()), "hash": pa.array(h, pa.string()), "path": pa.array(p, pa.list_(STEP))})


def forest(leaves: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(leaves with level, idx and path of their subtree's top; path and root above each such top).

    leaves: g (never null), the key they ascend by, leaf; other columns are carried along. Ties of the
    key go by the digest, so equal rows are the only ones whose order is open.
    """
    arrow_batches(leaves.sparkSession)
    order = ["g", key, "leaf"]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    ranged = cut(ranged.mapInArrow(numbered, schema(f"{kinds}, place long")))
    counts = cut(ranged.groupBy("pid", "g").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = few(cut(counts.select("pid", "g", before.alias("before")).where("before > 0")))  # a row a partition at most
    ranked = ranged.join(offsets, ["pid", "g"], "left").withColumn("rank", F.col("place") + F.coalesce("before", F.lit(0))).drop("before", "place", "pid")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    rows = cut(ranked.mapInArrow(local_trees, schema(f"{kinds}, level int, idx long, top string, path {PATH}")))

    sizes = counts.groupBy("g").agg(F.sum("n").alias("size"))
    sizes = cut(sizes.withColumn("height", F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0), lambda h, k: h + (F.pow(F.lit(float(FANOUT)), k - 1) < F.col("size")).cast("int"))))
    tops = cut(rows.where("top is not null").select("g", "level", "idx", F.col("top").alias("hash")).join(sizes, "g"))
    highest = sizes.agg(F.max("height")).first()[0] or 0
    bands, below = [], tops
    roots = tops.where("level = height").select("g", F.col("hash").alias("root"))
    for band in range(-(-highest // BAND)):
        last = F.lit((band + 1) * BAND)
        now = below.where(F.col("level") < F.least("height", last)).withColumn("stop", F.least("height", last))
        block = F.floor(F.col("idx") / F.pow(F.lit(float(FANOUT)), last - F.col("level"))).alias("block")
        out = cut(now.groupBy("g", block).applyInArrow(climbed, schema(f"g string, level int, idx long, hash string, path {PATH}")))
        bands.append(out.where("hash is null").join(sizes, "g").withColumn("stop", F.least("height", last)))
        over = cut(out.where("hash is not null").select("g", "level", "idx", "hash").join(sizes, "g"))
        roots = roots.unionByName(over.where("level = height").select("g", F.col("hash").alias("root")))
        below = over.unionByName(tops.where(F.col("level") == last))
    above = None
    for out in reversed(bands):
        here = out.select("g", "level", "idx", "path", F.floor(F.col("idx") / F.pow(F.lit(float(FANOUT)), F.col("stop") - F.col("level"))).alias("up"), "stop")
        if above is not None:
            over = above.select("g", F.col("level").alias("stop"), F.col("idx").alias("up"), F.col("path").alias("rest"))
            here = here.join(over, ["g", "stop", "up"], "left").withColumn("path", F.concat("path", F.coalesce("rest", F.array().cast(PATH))))
        here = here.select("g", "level", "idx", "path")
        above = cut(here if above is None else here.unionByName(above))
    roots = cut(roots)
    upper = tops.select("g", "level", "idx").join(roots, "g")
    upper = upper.withColumn("above", F.array().cast(PATH)) if above is None else upper.join(above.withColumnRenamed("path", "above"), ["g", "level", "idx"], "left")
    return rows.drop("top", "rank"), cut(upper.withColumn("above", F.coalesce("above", F.array().cast(PATH))))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", key: str = "doc_id", tampered: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, path, claimed) for each row: path has the digests left and right of the way up, level by level.

    Groups ascend by their UTF-8 bytes, null first; the rows of a group by key, null first; ties by leaf,
    so rows that repeat a key have a place each, and rows that are equal have equal leaves. ``tampered``
    replaces fields of the leaf that claims to be in the data set (``claimed``; null: the leaf itself).
    Texts of any length are hashed by Spark and never reach Python. Columns outside ``fields`` are
    ignored whatever their names; fields go by name in any order of the table. An empty table gives no rows.
    """
    own = [F.col(f) for f in fields]
    changed = [(tampered or {}).get(f, F.col(f)) for f in fields]
    g = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = cut(docs.select(g.alias("g"), F.col(key).alias("key"), leaf_of(*own).alias("leaf"), (leaf_of(*changed) if tampered else F.lit(None).cast("string")).alias("claimed")))
    rows, upper = forest(leaves, "key")
    subroots = upper.select("g", "root").distinct().select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("root").alias("leaf"))
    groups, top = forest(cut(subroots), "key")
    groups = groups.join(top, ["g", "level", "idx"]).select(F.col("key").alias("g"), F.concat("path", "above").alias("last"), F.col("root").alias("whole"))
    upper = cut(upper.join(groups, "g").select("g", "level", "idx", F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("above", "last").alias("above")))
    out = rows.join(upper, ["g", "level", "idx"])
    return out.select(F.col("key").alias(key), "leaf", "subroot", "root", F.concat("path", "above").alias("path"), "claimed")


def verified(rows: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with proof_sha256, folded_root (of the claimed leaf) and verified."""
    proof, root, ok = fresh(rows, "proof_sha256", "folded_root", "verified")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    out = rows.withColumn(proof, F.sha2(siblings, 256)).withColumn(root, folded(F.col("path"), F.coalesce("claimed", "leaf")))
    return out.withColumn(ok, F.col(root) == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = verified(manifest(docs, tampered={"text": text}))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: CRC-32 by its table, over a list of bytes; both queries below derive the table from the reversed polynomial.
CRC_TABLE = """
crc(t) AS (SELECT list(c ORDER BY i) FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))))
"""
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"

OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (
    SELECT *, CASE WHEN {CRC.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
    FROM documents, crc),
p AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, text, changed,
           coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head
    FROM d),
l AS (
    SELECT doc_id, g, leaf, claimed, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
    FROM (SELECT doc_id, g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                 sha256(head || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) AS claimed FROM p)),
lev AS (
    SELECT g, 0 AS k, i, n, leaf AS h FROM l
    UNION ALL
    SELECT g, k + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM lev WHERE n > 1 GROUP BY g, k, i // 3),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS m FROM lev WHERE n = 1),
top AS (
    SELECT 0 AS k, j AS i, m AS n, subroot AS h FROM sub
    UNION ALL
    SELECT k + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 3),
kin AS (
    SELECT a.g, a.k, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS hi
    FROM (SELECT g, k, i, h, n FROM lev UNION ALL SELECT '~', k, i, h, n FROM top) AS a
    JOIN (SELECT g, k, i, h FROM lev UNION ALL SELECT '~', k, i, h FROM top) AS b ON a.g = b.g AND a.k = b.k AND a.i // 3 = b.i // 3
    WHERE a.n > 1 GROUP BY a.g, a.k, a.i),
way AS (
    SELECT row_number() OVER () AS r, doc_id, g, leaf, 0 AS k, i, claimed AS h, '' AS proof FROM l
    UNION ALL
    SELECT r, doc_id, way.g, leaf, way.k + 1, way.i // 3, sha256(lo || h || hi), proof || lo || hi
    FROM way JOIN kin ON kin.g = way.g AND kin.k = way.k AND kin.i = way.i),
low AS (SELECT w.*, s.subroot, s.j FROM way AS w JOIN sub AS s USING (g) JOIN (SELECT g, max(k) AS k FROM lev GROUP BY g) AS e ON e.g = w.g AND e.k = w.k),
up AS (
    SELECT r, doc_id, leaf, subroot, 0 AS k, j AS i, h, proof FROM low
    UNION ALL
    SELECT r, doc_id, leaf, subroot, up.k + 1, up.i // 3, sha256(lo || h || hi), proof || lo || hi
    FROM up JOIN kin ON kin.g = '~' AND kin.k = up.k AND kin.i = up.i)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM up, (SELECT h AS root FROM top WHERE n = 1) WHERE k = (SELECT max(k) FROM top)
"""
