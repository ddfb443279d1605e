"""Connected components of a table of links: alternating large and small stars while it is large, then one union in memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, schema

#: Pairs up to this number, whatever the input, are joined up by one task (some tens of MB); more go through rounds of stars first.
TOGETHER = 500_000


def joined_up(batches):
    """(id, component) for every end of the pairs (u, v), all of which this task gets."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ids, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in "uv"]), return_inverse=True)
    low, (x, y) = np.arange(len(ids)), at.reshape(2, -1)
    while len(x):
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))  # roots hook on smaller ones
        while (low[low] != low).any():
            low = low[low]
        x, y = low[x], low[y]
        x, y = x[x != y], y[x != y]
    kind = table.schema.field("u").type
    yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(ids[low], kind)], names=["id", "component"])


def together(pairs: DataFrame) -> DataFrame:
    kind = pairs.schema["u"].dataType.simpleString()
    return cut(pairs.coalesce(1).mapInArrow(joined_up, schema(f"id {kind}, component {kind}")))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of a link (a, b); component is the smallest id that links reach.

    Up to ``TOGETHER`` pairs are joined up in one task of bounded size, without a shuffle. While there
    are more, each round hooks neighbours on the smallest one known; rounds keep the components, so
    the rest can be joined up after any of them. Rounds are written to the shared checkpoint folder;
    their number grows with the logarithm of a component's size. Minima are written before they meet
    the pairs again, so that the join of a hub with its many neighbours can be split. Ids without links
    do not appear. Repeated links, loops and either direction are fine.
    """
    pairs = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    if pairs.count() <= TOGETHER:
        return together(pairs)
    pairs, was = cut(pairs.distinct()), None
    while True:
        both = pairs.union(pairs.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m"))).where("u <> v").distinct()
        pairs = cut(small)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now[0] <= TOGETHER:
            return together(pairs)
        if now == was:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select(F.col("v"), F.col("v"))).distinct()
        was = now
