"""Snapshot exchange (E14, K21-K23, U4): idempotent union of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pulled(local: DataFrame, remote: DataFrame, key: str = "event_id") -> DataFrame:
    """Remote rows that the local table lacks, each once."""
    return remote.dropDuplicates([key]).join(local.select(key), key, "left_anti").select(*local.columns)


def union(local: DataFrame, remote: DataFrame, key: str = "event_id") -> DataFrame:
    """U4: local rows win; pulling twice or in either order gives the same ids."""
    return local.unionByName(pulled(local, remote.select(*local.columns), key))


def snapshot_rows(table: DataFrame, kind: str) -> DataFrame:
    """One JSON line {kind, row} for each row."""
    return table.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*table.columns).alias("row"))).alias("value"))
