"""Substring dedup (operator 1): seed and extend on winnowed anchors.

Seeds: of the word grams in every window of ``length`` words the least hash (the rightmost of equal
ones) is an anchor, so two equal windows have the same anchor at the same place; an anchor owns the
consecutive windows that chose it. Documents join on anchors that more than one of them has.

Extension goes both ways from an anchor. If all the words of its windows are equal to those round the
same anchor in an earlier document, they are a repeat as a whole. Where contexts differ, one document
of each distinct context compares its windows singly, which finds how far the match goes left and
right. Overlapping repeats merge into maximal ones. Groups are only ever reduced to their smallest
document, so a passage in thousands of documents costs a multiple of their number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, cut, schema, split_by_ids, table, with_side
from .hashing import mix, prefix_sums, span_hash, split_words, steps

#: Words of an anchor gram.
GRAM = 16
#: Low bits of a packed gram that hold its place; the others hold the upper bits of its hash.
PLACE_BITS = 28
U = np.uint64


def chosen(grams: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the least of grams[i : i + width], the rightmost of equals."""
    low = U((1 << PLACE_BITS) - 1)
    packed = (grams & ~low) | (low - np.arange(len(grams), dtype=U))
    have = 1
    while have * 2 <= width:
        packed = np.minimum(packed[:-have], packed[have:])
        have *= 2
    rest = width - have
    packed = np.minimum(packed[: len(packed) - rest], packed[rest:]) if rest else packed
    return (low - (packed & low)).astype(np.int64)


def anchors(length: int, gram: int):
    """(doc_id, start, n, h, e): an anchor's hash, the run of windows it owns, and the hash of all their words.

    In texts that repeat a few words over and over, neighbouring anchors of equal hashes are one row.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, _, raw, offsets in steps(batch.column("text")):
                w = split_words(raw, offsets, fold=False)
                if len(w.hash) < length:
                    continue
                total = prefix_sums(w.hash)
                at = np.arange(len(w.hash) - gram + 1)
                grams = span_hash(total, at, at + gram)
                place = chosen(grams, length - gram + 1)
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
                start = np.arange(len(place))
                inside = doc[start] == doc[start + length - 1]
                start, place = start[inside], place[inside]
                if not len(start):
                    continue
                edge = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
                first, n = start[edge], np.diff(np.r_[edge, len(start)])
                h = grams[place[edge]]
                e = mix(span_hash(total, first, first + n - 1 + length) + (place[edge] - first).astype(U) * U(0x9E3779B97F4A7C15))
                own = doc[first]
                new = np.r_[True, (h[1:] != h[:-1]) | (e[1:] != e[:-1]) | (own[1:] != own[:-1]) | (first[1:] != first[:-1] + n[:-1])]
                at = np.flatnonzero(new)
                n, first, h, e, own = np.add.reduceat(n, at), first[at], h[at], e[at], own[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a + own], pa.int64()), pa.array(first - w.first[own], pa.int64()), pa.array(n, pa.int32()), pa.array(h.view(np.int64)), pa.array(e.view(np.int64))],
                    names=["doc_id", "start", "n", "h", "e"],
                )

    return run


def flat(lists: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of a list of structs; null lists are empty."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    inner = lists.flatten()
    return np.r_[0, np.cumsum(sizes)], [inner.field(f).to_numpy(zero_copy_only=False) if len(inner) else np.zeros(0, np.int64) for f in fields]


def single_windows(length: int):
    """(h, x, doc_id, start): the windows that given anchors own, by their own hash x."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            edges, (hs, firsts, ns) = flat(batch.column("runs"), "h", "start", "n")
            for a, b, raw, offsets in steps(batch.column("text")):
                w = split_words(raw, offsets, fold=False)
                total = prefix_sums(w.hash)
                for i in range(a, b):
                    n, first = (v[edges[i] : edges[i + 1]].astype(np.int64) for v in (ns, firsts))
                    h = np.repeat(hs[edges[i] : edges[i + 1]], n)
                    start = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    at = start + w.first[i - a]
                    x = span_hash(total, at, at + length).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(x), pa.array(np.full(len(h), ids[i])), pa.array(start)], names=["h", "x", "doc_id", "start"])

    return run


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching spans as maximal ones, in order."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return list(zip(start[new].tolist(), reach[np.r_[new[1:] - 1, len(start) - 1]].tolist(), strict=True))


def without_spans(with_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            edges, (starts, ends) = flat(batch.column("spans"), "s", "e")
            for i, (d, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                words = (text or "").encode().split()
                n, spans = len(words), merged(starts[edges[i] : edges[i + 1]], ends[edges[i] : edges[i + 1]])
                for s, e in reversed(spans):
                    del words[s:e]
                kept = b" ".join(words)
                rows.append((d, n, n - len(words), hashlib.sha256(kept).hexdigest(), [{"s": s, "e": e} for s, e in spans], kept.decode() if with_text else None))
            d, n, r, k, s, t = zip(*rows, strict=True) if rows else ((),) * 6
            span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            arrays = [pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.string()), pa.array(s, span), pa.array(t, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    return run


def repeats(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, s, e): word spans s..e-1 whose windows of ``length`` words all start in an earlier document too; they may overlap."""
    found = docs.mapInArrow(anchors(length, gram), schema("doc_id long, start long, n int, h long, e long"))
    shared = found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("h")
    shared = cut(shared)
    found = cut(found.join(shared, "h", "left_semi"))
    # minima of hashes are written before they meet the anchors, so that the join can split a hot one
    contexts = cut(found.groupBy("h", "e").agg(F.min("doc_id").alias("least")))
    known = cut(found.join(contexts, ["h", "e"]))
    whole = known.where("doc_id > least").select("doc_id", F.col("start").alias("s"), (F.col("start") + F.col("n") - 1 + length).alias("e"))

    mixed = contexts.groupBy("h").agg(F.count("*").alias("kinds"), F.min("least").alias("lo"), F.max("least").alias("hi")).where("kinds > 1 and lo <> hi").select("h")
    single = known.where("doc_id = least").join(mixed, "h", "left_semi")
    runs = single.groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "n")).alias("runs"))
    runs = cut(runs)
    windows = split_by_ids(docs, runs)[1].join(runs, "doc_id").select("doc_id", "text", "runs").mapInArrow(single_windows(length), schema("h long, x long, doc_id long, start long"))
    windows = cut(windows)
    least = cut(windows.groupBy("h", "x").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").select("h", "x", "least"))
    parts = windows.join(least, ["h", "x"]).where("doc_id > least").select("doc_id", F.col("start").alias("s"), (F.col("start") + length).alias("e"))
    return whole.union(parts)


def substring_dedup(docs: DataFrame, length: int = 50, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, spans (removed word ranges s..e-1), kept_text.

    docs: doc_id long (unique, not null) and text; other columns are ignored. Words stand between ASCII
    white space and are compared unchanged, by 64-bit hashes within groups of equal 64-bit anchors.
    A word goes if a window of ``length`` words that covers it also starts in a document with a smaller
    doc_id. Null, empty and shorter texts keep all their words; an empty table gives no rows. Texts may
    have any length. A row that repeats a doc_id with its text gets the same result once more; a row
    without a doc_id keeps all its words, and no other loses any for it. Texts
    without a repeat pass straight through: only the others meet their spans.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = cut(repeats(docs.where("doc_id is not null"), length, gram).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    out = with_side(docs, spans).mapInArrow(without_spans(with_text), schema("doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<s:long,e:long>>, kept_text string"))
    return out if with_text else out.drop("kept_text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
r AS (SELECT DISTINCT x.doc_id, unnest(range(i, i + 50)) AS pos FROM x JOIN m USING (h) WHERE x.doc_id > m.least),
g AS (SELECT doc_id, list(pos) AS gone FROM r GROUP BY doc_id),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.pos) AS kept FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.pos = t.pos
      WHERE r.pos IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
