"""Keyed tables that change in place (K3, K4, K17, K18, K24): buckets of Parquet files under a versioned manifest.

A change reads and writes the buckets that its keys fall into and nothing else; all other buckets go on
pointing at the files they had. A new version is one small file that names every bucket's folders; it is
created last and only if nobody else has created it, so a writer that dies before leaves the old version,
and a reader sees one version whole.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published the next version first."""


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key; ``bucket_on_driver`` gives the same for a string."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % buckets).cast("int")


def bucket_on_driver(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode()) % buckets


def files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, whatever store it is in, and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Versioned:
    """A table of ``ddl`` at ``folder``; rows with equal ``by`` share a bucket, which holds them sorted by ``order``.

    ``bloom`` names columns whose files get Bloom filters. Readers of one version are not disturbed by
    later ones until ``vacuum`` removes what only older versions name. A change may carry the number of a
    batch: once a version with it is there, the same batch changes nothing, and ``before`` gives the rows as
    the batch found them, so that a batch that is run again after a failure goes on where it stopped.
    """

    def __init__(self, spark: SparkSession, folder: str, ddl, by: str, buckets: int = 64, order: Iterable[str] = (), bloom: Iterable[str] = (), page_rows: int | None = None):
        self.spark, self.folder, self.ddl, self.by, self.buckets = spark, folder.rstrip("/"), ddl, by, buckets
        self.order = list(order) or [by]
        self.options = {"compression": "zstd"} | {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom}
        if page_rows:
            self.options["parquet.page.row.count.limit"] = str(page_rows)

    def versions(self) -> list[int]:
        fs, path = files(self.spark, f"{self.folder}/versions")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []

    def manifest(self, version: int | None = None) -> dict[int, list[str]]:
        """Folders of each bucket in a version (default: the last one)."""
        return {int(b): paths for b, paths in self.published(version)["buckets"].items()}

    def published(self, version: int | None = None) -> dict:
        """A version's buckets and the last batch that it holds."""
        version = self.last() if version is None else version
        if not version:
            return {"buckets": {}, "batch": -1}
        fs, path = files(self.spark, f"{self.folder}/versions/{version:012d}.json")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def batch(self) -> int:
        """The last batch that has changed the table; -1 if none has."""
        return self.published()["batch"]

    def before(self, batch: int) -> int:
        """The last version without this batch; 0 if there is none."""
        return next((v for v in reversed(self.versions()) if self.published(v)["batch"] < batch), 0)

    def publish(self, manifest: dict[int, list[str]], after: int, batch: int | None = None) -> int:
        """Make the version after ``after``; raises ``Conflict`` if it exists."""
        batch = self.published(after)["batch"] if batch is None else batch
        fs, path = files(self.spark, f"{self.folder}/versions/{after + 1:012d}.json")
        try:
            stream = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise Conflict(str(path)) from e
            raise
        try:
            stream.write(bytearray(json.dumps({"buckets": manifest, "batch": batch}, sort_keys=True), "utf-8"))
        finally:
            stream.close()
        return after + 1

    def last(self) -> int:
        return (self.versions() or [0])[-1]

    def read(self, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        held = self.manifest(version)
        paths = [f"{self.folder}/{p}" for b in sorted(held if buckets is None else set(buckets) & set(held)) for p in held[b]]
        return self.spark.read.schema(self.ddl).parquet(*paths) if paths else self.spark.createDataFrame([], self.ddl)

    def of_keys(self, keys: Iterable[str], version: int | None = None) -> DataFrame:
        """The rows of some keys: only their buckets are opened, and in these only row groups that may hold a key (sorted files, Bloom filters)."""
        keys = sorted(set(keys))
        rows = self.read({bucket_on_driver(k, self.buckets) for k in keys}, version)
        return rows.where(listed(self.by, keys))

    def _written(self, rows: DataFrame, unpack: Callable[[DataFrame], DataFrame] | None = None) -> dict[int, list[str]]:
        """Write rows by bucket under a new folder: bucket -> folder. With ``unpack`` the rows know their bucket and become the table's rows only after they have moved."""
        made = f"data/{uuid.uuid4().hex}"
        rows = rows if unpack else rows.withColumn("bucket", bucket_of(F.col(self.by), self.buckets))
        rows = (unpack or (lambda r: r))(rows.hint("rebalance", "bucket")).sortWithinPartitions("bucket", *self.order)
        rows.write.options(**self.options).partitionBy("bucket").parquet(f"{self.folder}/{made}")
        fs, path = files(self.spark, f"{self.folder}/{made}")
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return {int(n.removeprefix("bucket=")): [f"{made}/{n}"] for n in names if n.startswith("bucket=")}

    def append(self, rows: DataFrame, batch: int | None = None, unpack: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """A version with more rows; no bucket is read."""
        if batch is not None and self.batch() >= batch:
            return self.last()
        after, now = self.last(), self.manifest()
        for b, paths in self._written(rows, unpack).items():
            now[b] = [*now.get(b, []), *paths]
        return self.publish(now, after, batch)

    def upsert(self, rows: DataFrame, keys: Iterable[str] | None = None, gone: DataFrame | None = None, batch: int | None = None) -> int:
        """A version in which rows replace those with equal ``keys`` (default: the bucket key) and the keys of ``gone`` have no rows.

        Only buckets of these keys are read and rewritten. Rows must be unique by keys.
        """
        if batch is not None and self.batch() >= batch:
            return self.last()
        keys = list(keys or [self.by])
        after, now = self.last(), self.manifest()
        out = rows.select(*keys) if gone is None else rows.select(*keys).unionByName(gone.select(*keys))
        touched = [r[0] for r in out.select(bucket_of(F.col(self.by), self.buckets)).distinct().collect()]
        old = self.read(touched)
        kept = old.join(out.distinct(), keys, "left_anti").select(*old.columns)
        made = self._written(kept.unionByName(rows.select(*old.columns)))
        for b in touched:
            now.pop(b, None)
        return self.publish(now | made, after, batch)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove data folders that none of the last ``keep`` versions names, and older versions; returns what went. Not while a writer is at work."""
        have = self.versions()
        used = {p.split("/bucket=")[0] for v in have[-keep:] for paths in self.manifest(v).values() for p in paths}
        fs, data = files(self.spark, f"{self.folder}/data")
        gone = [f"data/{s.getPath().getName()}" for s in fs.listStatus(data) if f"data/{s.getPath().getName()}" not in used] if fs.exists(data) else []
        for name in [f"versions/{v:012d}.json" for v in have[:-keep]] + gone:
            fs.delete(files(self.spark, f"{self.folder}/{name}")[1], True)
        return gone


#: Values of one IN list that Spark hands to Parquet one by one, so that statistics and Bloom filters of row groups decide on each.
PUSHED = 10


def listed(column: str, keys: list[str]) -> Column:
    """column is one of the sorted keys, as a balanced tree of lists that Parquet takes."""
    parts = [F.col(column).isin(keys[i : i + PUSHED]) for i in range(0, len(keys), PUSHED)]
    while len(parts) > 1:
        parts = [parts[i] | parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(False)
