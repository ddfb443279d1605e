"""What several operators share: reading tables, durable cut points, column-name safety, word counts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that ends a word, as a Java character class.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; works for any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so that long texts cannot fill a Python worker.

    Plans read these settings when they run, so they stay; a session that has set its own keeps them.
    """
    for name, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "500"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))):
        if spark.sparkContext.getConf().get(name) is None:
            spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under the one the cluster names in spark.checkpoint.dir.

    Only a local session, whose driver and executors are one process, may go without that setting; it
    gets a temporary folder. A cluster without it raises, since its executors would not see each other's files.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/tables-{context.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, context, folder)
    return folder


_FOLDERS: set[str] = set()


def _remove(context, folder: str) -> None:
    if context._jsc is not None and not context._jsc.sc().isStopped():
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    The table survives the loss of any executor, and later plans start from its true size (a plain
    checkpoint carries the estimates of the plan before it, which loops blow up). The tables go when
    the application ends.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folded(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def pieces(text: Column, separators: str) -> Column:
    """The non-empty pieces of a text between runs of separator characters; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{separators}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words between white space (null: 0)."""
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def schema(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


#: Bits of one bitmap of Spark's bitmap functions; all bitmaps of one filter never take more than MOST_BITS (32 MB), whatever the input.
BITMAP = 32768
MOST_BITS = 1 << 28
#: Bits for each member, and slots that a member sets.
BITS_EACH, SLOTS = 32, 3


def filter_bits(members: int, each: int = BITS_EACH) -> int:
    """Size of a filter for so many members: a power of two from one bitmap up to ``MOST_BITS``."""
    return min(MOST_BITS, max(BITMAP, 1 << (each * max(members, 1) - 1).bit_length()))


def bitmaps(slots: DataFrame) -> DataFrame:
    """(bucket, bitmap) of the slots (slot) that occur; summed on the map side, at most bits / 32768 rows."""
    return slots.groupBy(F.floor(F.col("slot") / BITMAP).alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BITMAP).alias("bitmap"))


def is_set(bitmap: Column, slot: Column) -> Column:
    """Whether a bitmap (null: empty) has the bit of a slot."""
    position = slot % BITMAP
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def marked(df: DataFrame, maps: DataFrame, slots: list[Column], mark: str) -> DataFrame:
    """df with a boolean column ``mark``: whether all slots are set in the broadcast bitmaps (of bounded size)."""
    columns, hit = df.columns, F.lit(True)
    for i, slot in enumerate(slots):
        s, b, m = fresh(df, f"s{i}", f"b{i}", f"m{i}")
        side = F.broadcast(maps.select(F.col("bucket").alias(b), F.col("bitmap").alias(m)))
        df = df.withColumn(s, slot).join(side, F.floor(F.col(s) / BITMAP) == F.col(b), "left")
        hit = hit & is_set(F.col(m), F.col(s))
    return df.select(*columns, hit.alias(mark))


def id_slots(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key.cast("string")), F.lit(bits)) for i in range(SLOTS)]


def split_by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", members: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is certainly not among ids, rows whose key may be): a Bloom filter of ids, broadcast, whose size is bounded.

    ids: one column, named as key, written before. Only the second part (ids' own rows, and one in 600 of
    the others while the filter has room) needs a join, so texts without a partner stay where they are.
    """
    bits = filter_bits(ids.count() if members is None else members)
    maps = cut(bitmaps(ids.select(F.explode(F.array(*id_slots(F.col(key), bits))).alias("slot"))))
    (mark,) = fresh(docs, "may_be")
    both = marked(docs, maps, id_slots(F.col(key), bits), mark)
    return both.where(~F.col(mark)).drop(mark), both.where(F.col(mark)).drop(mark)


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs' rows whose key is not among ids (key); rows with a null key stay.

    What goes, and few others, meets the ids in a merge join, the same at every size; all other texts
    pass straight through, however many ids there are.
    """
    ids = cut(ids.select(key).distinct())
    rest, maybe = split_by_ids(docs, ids, key)
    return rest.unionByName(maybe.join(ids.hint("merge"), key, "left_anti").select(docs.columns))


def with_side(docs: DataFrame, side: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with the columns of side (one row for each key, written before), null where there is none; only rows that may have one shuffle."""
    rest, maybe = split_by_ids(docs, side.select(key), key)
    more = [c for c in side.columns if c != key]
    missing = [F.lit(None).cast(side.schema[c].dataType).alias(c) for c in more]
    return rest.select(*docs.columns, *missing).unionByName(maybe.join(side.hint("merge"), key, "left").select(*docs.columns, *more))


def few(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of a few numbers a row, broadcast while it has at most ``most`` rows; beyond, Spark decides by its size."""
    return F.broadcast(ids) if ids.count() <= most else ids
