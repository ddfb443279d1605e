"""Sources and sinks (S12-S19, S21, K21, K23, K24, K28, X7): snapshots, chat corpora, fixtures, resumable JSON lines, reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import answer_text
from ..operators.sync import snapshot_rows, union

#: Formats of session dates, tried in order.
DATE_FORMATS = ("h:mm a 'on' d MMMM, yyyy", "h:mm a 'on' d MMMM yyyy", "d MMMM, yyyy", "d MMMM yyyy", "yyyy-MM-dd")


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Compressed JSON lines {kind, row}, one folder for a snapshot."""
    lines = None
    for kind, table in tables.items():
        rows = snapshot_rows(table, kind)
        lines = rows if lines is None else lines.unionByName(rows)
    lines.write.mode("errorifexists").option("compression", "gzip").text(path)


def read_snapshot(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    """A DataFrame for each kind; lines of unknown kinds and torn lines are skipped."""
    lines = spark.read.text(path)
    kind = F.get_json_object("value", "$.kind")
    return {k: lines.where(kind == k).select(F.from_json(F.get_json_object("value", "$.row"), ddl).alias("row")).where("row is not null").select("row.*") for k, ddl in schemas.items()}


def content_key(table: DataFrame) -> str:
    """A hash of a table's rows, whatever their order; equal tables have equal keys. 64 bits of each SHA-256, summed in four parts."""
    digest = F.sha2(F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(digest, 16 * i + 1, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    n, *sums = table.agg(F.count("*"), *parts).first()
    return f"{n:x}-" + "".join(f"{int(v or 0) & ((1 << 64) - 1):016x}" for v in sums)


class SnapshotStore:
    """Snapshots of workstreams under one folder, by the content they hold: workstreams/{id}/snapshots/{key}."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, workstream: str) -> list[str]:
        """The snapshots of a workstream, in order of their names."""
        path, system = self._path("workstreams", workstream, "snapshots")
        if not system.exists(path):
            return []
        return sorted(s.getPath().getName() for s in system.listStatus(path) if not s.getPath().getName().startswith(("_", ".")))

    def push(self, workstream: str, tables: dict[str, DataFrame]) -> tuple[str, bool]:
        """(name, whether it is new): the same content is pushed once; a name that holds other content raises."""
        keys = {kind: content_key(t) for kind, t in sorted(tables.items())}
        name = hashlib.sha256(json.dumps(keys).encode()).hexdigest()[:40]
        if name in self.names(workstream):
            have = self.pull(workstream, name, {k: t.schema for k, t in tables.items()})
            if {k: content_key(t) for k, t in have.items()} != keys:
                raise ValueError(f"snapshot {name} holds other content")
            return name, False
        write_snapshot(tables, f"{self.folder}/workstreams/{workstream}/snapshots/{name}")
        return name, True

    def pull(self, workstream: str, name: str, schemas: dict) -> dict[str, DataFrame]:
        return read_snapshot(self.spark, f"{self.folder}/workstreams/{workstream}/snapshots/{name}", schemas)

    def pull_all(self, workstream: str, local: dict[str, DataFrame], keys: dict[str, str]) -> dict[str, DataFrame]:
        """Local tables with the rows of every snapshot that they lack, kind by kind; pulling again adds nothing."""
        schemas = {k: t.schema for k, t in local.items()}
        for name in self.names(workstream):
            remote = self.pull(workstream, name, schemas)
            local = {k: union(t, remote[k], keys[k]) for k, t in local.items()}
        return local


def session_date(text: Column, session: Column) -> Column:
    """The first format that fits, else 2023-01-01 and as many days as the session's number."""
    tries = [F.try_to_timestamp(F.regexp_replace(text, r"\s+", " "), F.lit(f)) for f in DATE_FORMATS]
    upper = F.regexp_replace(F.regexp_replace(text, r"\bam\b", "AM"), r"\bpm\b", "PM")
    tries = [F.try_to_timestamp(upper, F.lit(f)) for f in DATE_FORMATS] + tries
    return F.coalesce(*tries, F.date_add(F.lit("2023-01-01").cast("date"), session).cast("timestamp"))


def chat_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of a chat corpus; sessions have keys of their own, so a conversation is read as a map."""
    ddl = "sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:variant,adversarial_answer:variant,category:int>>"
    raw = spark.read.schema(ddl).option("multiLine", True).json(path)
    parts = raw.select("sample_id", "conversation", F.explode("conversation").alias("key", "body")).where(F.col("key").rlike("^session_[0-9]+$"))
    number = F.regexp_extract("key", "([0-9]+)$", 1).cast("int")
    when = session_date(F.element_at("conversation", F.concat("key", F.lit("_date_time"))), number)
    turns = parts.select("sample_id", number.alias("session"), when.alias("at"), F.posexplode(F.from_json("body", "array<struct<speaker:string,text:string>>")).alias("turn", "t"))
    questions = raw.select("sample_id", F.posexplode("qa").alias("number", "q")).select("sample_id", "number", "q.question", F.coalesce(answer_text(F.col("q.answer")), answer_text(F.col("q.adversarial_answer")), F.lit("")).alias("answer"), "q.category")
    return turns.select("sample_id", "session", "at", "turn", "t.speaker", "t.text"), questions


def bench_fixture(spark: SparkSession, path: str) -> DataFrame:
    """S15."""
    ddl = "name string, workstream string, turns array<struct<speaker:string,at:string,content:string,shouldCapture:boolean,category:string>>, probes array<struct<question:string,expectedSubstring:string,asOf:string>>"
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def resumed(spark: SparkSession, path: str, ddl: str, keys: tuple[str, ...] = ("sample_id", "question")) -> DataFrame:
    """The last line of each key; torn lines are skipped."""
    rows = spark.read.schema(ddl).option("mode", "DROPMALFORMED").json(path).select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("_f", "_i")]), F.struct("_f", "_i")).alias("x"))
    return last.select("x.*")


def write_report(table: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header and quoted fields, JSON lines, or a Markdown table in one file (reports are a few rows)."""
    writer = table.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        markdown(table).coalesce(1).write.mode("overwrite").text(path)


def markdown(table: DataFrame) -> DataFrame:
    """Lines of a Markdown table, heading first."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    rows = table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, table.columns)), F.lit(" |")).alias("value"))
    head = table.sparkSession.createDataFrame([("| " + " | ".join(table.columns) + " |",), ("|" + "-|" * len(table.columns),)], "value string").coalesce(1)
    return head.union(rows)


#: Kinds of context entries by name.
ENTRY_KINDS = ("UserMessage", "AssistantMessage", "FileContent", "ToolCall", "ToolResult", "SubAgentOutput", "SystemNote", "External")


def entry_array(rows: DataFrame, column: str = "body") -> DataFrame:
    """JSON arrays of entries {entry_id, timestamp, kind, text, source_ref} as rows; a required field that is missing or an unknown kind raises."""
    each = rows.select(F.posexplode(F.from_json(column, "array<struct<entry_id:string,timestamp:string,kind:string,text:string,source_ref:string>>")).alias("at", "e")).select("at", "e.*")
    need = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"entry without {c}: "), F.col("at").cast("string"))).cast("string"))
    place = F.array_position(F.array(*[F.lit(k.lower()) for k in ENTRY_KINDS]), F.lower(need("kind")))
    kind = F.when(place > 0, place - 1).otherwise(F.raise_error(F.concat(F.lit("not a kind of entry: "), F.col("kind"))).cast("bigint"))
    return each.select(need("entry_id").alias("entry_id"), F.to_timestamp(need("timestamp")).alias("entry_at"), kind.cast("int").alias("kind"), need("text").alias("text"), "source_ref")


def sidecar_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples that a harness keeps beside the log, as JSON lines; the subject's key is made on reading."""
    from ..functions.text import subject_key

    rows = spark.read.schema("sample_id string, subject string, predicate string, object string, at string").option("mode", "DROPMALFORMED").json(path)
    return rows.where("subject is not null").withColumn("subject_key", subject_key(F.col("subject")))


def wiped(spark: SparkSession, folder: str) -> bool:
    """Remove a demo store's tables; the folder itself stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return all([system.delete(s.getPath(), True) for s in system.listStatus(path)]) if system.exists(path) else False
