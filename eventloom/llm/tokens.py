"""Token counts (operator 7): batch encoding in Arrow functions that return lengths only.

Byte-level texts are cut at safe boundaries: before a single blank between two visible characters.
Byte-level pre-tokenisers start a piece there whatever stands before or after, so the counts of the
parts add up to that of the whole, however long it is. Parts repeat a lot: the library encodes each distinct one
once, and a bounded memory of counts serves the rest. What is encoded goes in batches balanced by
bytes, so a task never encodes more than about ``BATCH_BYTES`` at once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, schema, table

BATCH_BYTES = 1 << 19
#: Counts of parts that a worker remembers, and the longest part that it remembers.
REMEMBERED, REMEMBERED_LENGTH = 500_000, 64
#: Not beside angle brackets, where a special string may stand.
_SAFE = re.compile(r"(?<=[!-;=?-~À-ɏ])(?= [!-;=?-~À-ɏ])")
_LOADED: dict = {}


def counter(path: str, special: tuple[str, ...] = ()):
    """A function from a list of texts to their numbers of tokens."""
    if path.endswith(".json"):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in m.encode(texts, num_threads=1)]
    raise ValueError(f"not a tokenizer that is known here: {path}")


def is_local(path: str) -> bool:
    """Whether the file states a byte-level pre-tokeniser that splits before a blank, with nothing before it that sees the whole text, and no added token holds a blank."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    pre = stated.get("pre_tokenizer") or {}
    if any(" " in t.get("content", "") or t.get("lstrip") or t.get("rstrip") for t in stated.get("added_tokens") or []):
        return False  # a cut might fall into it
    kinds = [pre, *(pre.get("pretokenizers") or [])]
    splits = any(k.get("type") == "ByteLevel" and k.get("use_regex", True) and not k.get("add_prefix_space") for k in kinds)
    return splits and not stated.get("normalizer") and (stated.get("model") or {}).get("type") == "BPE" and all(k.get("type") in ("ByteLevel", "Sequence", "Digits") for k in kinds)


def balanced(parts: list[str]) -> Iterator[list[str]]:
    """The parts in runs of about ``BATCH_BYTES``."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part.encode())
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def counts(path: str, limit: int, local: bool):
    """local: whether pieces do not depend on what stands beyond a safe boundary."""

    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = counter(path), {}
        count, known = _LOADED[path]
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            cut = [_SAFE.split(t) if local else [t] for t in texts]
            new = list({p for ps in cut for p in ps} - known.keys())
            here = {}
            for some in balanced(new):
                here.update(zip(some, count(some), strict=True))
            totals = [sum([here[p] if p in here else known[p] for p in ps]) for ps in cut]
            if len(known) > REMEMBERED:
                known.clear()
            known.update((p, n) for p, n in here.items() if len(p) <= REMEMBERED_LENGTH)
            sizes = [len(t.encode()) for t in texts]
            arrays = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_tokens and whether that is over ``limit``.

    Counts are those of the library on the whole text, without begin, end or added special tokens;
    null counts as empty (0 bytes, and what the library gives for an empty text). ``path`` must be
    readable on every executor. Texts are cut only where the file states a byte-level pre-tokeniser,
    whose pieces are local; they may have any length. Every row counts by itself: repeated rows and null
    ids give a row each, an empty table none. Other columns, whatever their names, are ignored.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(counts(path, limit, is_local(path)), schema("doc_id long, n_bytes long, n_tokens long, over_limit boolean"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
