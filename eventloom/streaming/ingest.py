"""Streaming ingestion (E7, K1, W1-W5): each micro-batch is appended once, then the observers see it; session offsets are kept state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schema as S
from ..operators import ingest
from ..sources.versioned import files, listed

#: Ids of a micro-batch that are looked up one by one; more go by their range.
LISTED = 2000
#: Ids of a micro-batch that are broadcast (about 100 bytes each).
MOST_IDS = 500_000

Observer = Callable[[DataFrame, int], None]


class Store:
    """Parquet tables of the log and its sidecars under one folder; each micro-batch has a folder of its own in every table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str, ddl, but: int | None = None) -> DataFrame:
        """A table's rows, or those of all batches but one."""
        try:
            rows = self.spark.read.schema(ddl).parquet(self.path(name))
        except Exception as e:  # the table does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], ddl)
        rows = rows if but is None or "batch_id" not in rows.columns else rows.where(F.col("batch_id") != but)
        return rows.select(self.spark.createDataFrame([], ddl).columns)

    def log(self, but: int | None = None) -> DataFrame:
        return self.read("log", S.LOG, but)

    def done(self, name: str, batch_id: int) -> bool:
        """Whether a table has all rows of a batch."""
        fs, path = files(self.spark, f"{self.path(name)}/batch_id={batch_id}/_SUCCESS")
        return fs.exists(path)

    def put(self, name: str, rows: DataFrame, batch_id: int, by: list[str] = (), **options: str) -> None:
        """Write a batch's rows; if they are there already, they are replaced."""
        writer = rows.write.mode("overwrite").options(**options)
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path(name)}/batch_id={batch_id}")


def append_batch(store: Store, now: Callable[[], str], reviewed: list[str] = (), observers: list[Observer] = (), seams: ingest.Seams = ingest.Seams()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: validate, redact, classify, drop known ids, write log, visibility, review and outbox rows, then call observers in order.

    Every table keeps a batch in a folder named by its number, and a batch that is run again after a
    failure overwrites its own: nothing is appended twice, and no sidecar is read. Sidecar rows go first,
    so that an event is never readable before its visibility is; once the log has the batch, a rerun takes
    the rows, stamps included, from there and only calls the observers, which know by the batch's number
    what they have done. Rows that are refused go to ``rejects`` with their reason.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if not store.done("log", batch_id):
            good, bad = ingest.validated(batch)
            store.put("rejects", bad, batch_id)
            rows = ingest.new_rows(ingest.prepared(good, now(), seams), known_events(store, good, batch_id)).persist()
            try:
                for name, side in {"visibility": ingest.sidecar_visibility(rows), "review": ingest.parked(rows, list(reviewed)), "outbox": ingest.outbox(rows)}.items():
                    store.put(name, side, batch_id)
                bloom = {"parquet.bloom.filter.enabled#event_id": "true"}
                store.put("log", rows.sortWithinPartitions("workstream_id", "event_id"), batch_id, ["workstream_id"], **bloom)
            finally:
                rows.unpersist()
        rows = store.spark.read.schema(S.LOG).parquet(f"{store.path('log')}/batch_id={batch_id}").select(store.log().columns)
        for observer in observers:
            observer(rows, batch_id)

    return run


def known_events(store: Store, batch: DataFrame, batch_id: int | None = None) -> DataFrame:
    """K1, S3: the ids of a batch that other batches of the log have.

    Few ids are looked up by name: files are sorted by id within a workstream and have Bloom filters, so
    row groups without such an id are skipped. More are looked for between the least and the greatest,
    which leaves out all files of other times where ids grow with time; up to a bound they are broadcast,
    so the log never shuffles.
    """
    ids, log = batch.select("event_id").distinct(), store.log(batch_id).select("event_id")
    some = [r[0] for r in ids.limit(LISTED + 1).collect()]
    if len(some) <= LISTED:
        return log.where(listed("event_id", sorted(some)))
    n, low, high = ids.agg(F.count("*"), F.min("event_id"), F.max("event_id")).first()
    log = log.where(F.col("event_id").between(low, high))
    return log.join(F.broadcast(ids), "event_id", "left_semi") if n <= MOST_IDS else log


def start_ingest(captures: DataFrame, store: Store, checkpoint: str, now: Callable[[], str], **options):
    """Start the single writer of a store on a stream of captures."""
    return captures.writeStream.foreachBatch(append_batch(store, now, **options)).option("checkpointLocation", checkpoint)


ENTRY_OUT = "session_id string, entry_id string, kind int, text string, from_entry string, to_entry string"


class SessionOffsets(StatefulProcessor):
    """Each session's offset (a value), the ranges it has given (a map), and a timer that forgets a session long after its last entry.

    What a batch gives of a session are its entries after the offset, once each and in order, with the
    range they make. Entries at or before the offset are never given again, whatever is sent again; the
    ranges are kept so that a host can tell a replay of a range from a new one.
    """

    def __init__(self, forget_ms: int | None = None, ranges_kept: int = 100):
        self.forget_ms, self.ranges_kept = forget_ms, ranges_kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.offset = handle.getValueState("offset", "last_entry string")
        self.ranges = handle.getMapState("ranges", "from_entry string", "to_entry string, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.offset.get()[0] if self.offset.exists() else ""
        new = pd.concat(list(rows)).sort_values("entry_id")
        new = new[new["entry_id"] > last].drop_duplicates("entry_id")
        if not len(new):
            return
        first, end = new["entry_id"].iloc[0], new["entry_id"].iloc[-1]
        self.ranges.updateValue((first,), (end, len(new)))
        for old in sorted(k[0] for k in self.ranges.keys())[: -self.ranges_kept]:
            self.ranges.removeKey((old,))
        self.offset.update((end,))
        if self.forget_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        yield new[["session_id", "entry_id", "kind", "text"]].assign(from_entry=first, to_entry=end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.offset.clear()
        self.ranges.clear()
        return iter(())

    def close(self) -> None:
        pass


def new_entries(entries: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """A stream of session entries without those at or before the session's offset, each with its range, whatever is sent again.

    State lives in RocksDB, so sessions need not fit in memory; it goes with the checkpoint, and a restart
    gives nothing twice.
    """
    entries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = entries.select("session_id", "entry_id", "kind", "text")
    return rows.groupBy("session_id").transformWithStateInPandas(SessionOffsets(forget_ms), ENTRY_OUT, "append", "ProcessingTime" if forget_ms is not None else "None")
