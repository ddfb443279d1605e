"""Evaluation: aggregates and the conversation benchmark."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as R
from ..functions.text import abstains, gold_support, terms

#: Ranges that a key's values are cut into, and the accuracy of the sketch that cuts them.
RANGES, SKETCH = 64, 500
#: Every so many cuts are looked at first, then those between two of them.
STRIDE = 8


def counts(log: DataFrame, revocations: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """A1, A2: one row of totals; with the outbox, how many events are queued."""
    if queue is not None:
        return counts(log, revocations).crossJoin(F.broadcast(queue.agg(F.count("*").alias("queued"))))  # one row each
    base = log.join(revocations.select("event_id", F.lit(1).alias("_r")), "event_id", "left")
    of = lambda c: F.count_if(F.col("category") == c)
    return base.agg(F.count("*").alias("events"), F.count("_r").alias("revoked"), of(1).alias("facts"), of(2).alias("decisions"), of(4).alias("goals"), of(3).alias("hypotheses"), F.countDistinct("workstream_id").alias("workstreams"))


def grouped(log: DataFrame, column: str) -> DataFrame:
    """A3."""
    return log.groupBy(column).agg(F.count("*").alias("n"))


def accuracy(graded: DataFrame) -> DataFrame:
    """Per category, for all, and for all but category 5: total, correct, ratio, mean tokens."""
    sets = F.array(F.col("category").cast("string"), F.lit("all"), F.when(F.col("category") != 5, F.lit("all but 5")))
    rows = graded.select(F.explode(sets).alias("part"), "correct", "tokens").where("part is not null")
    return rows.groupBy("part").agg(F.count("*").alias("total"), F.count_if("correct").alias("right"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("ratio"), F.round(F.avg("tokens"), 6).alias("mean_tokens"))


def percentile(rows: DataFrame, key: str, value: str, p: int) -> DataFrame:
    """The value at place max(1, n * p div 100) of the sorted values of each key; exact, by counts of equal values.

    A mergeable quantile sketch cuts a key's values into ranges of about equal numbers, whatever the values;
    sums over ranges find the one that holds the place, and only its values, counted, are put in order. So
    no key is sorted in one task as a whole: ranges of more than their share are single values, one row each.
    """
    from pyspark.sql import Window as W

    known = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    cuts = F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], SKETCH).alias("cuts")
    ends = known.groupBy("k").agg(cuts, F.count("*").alias("n")).withColumn("place", F.greatest(F.lit(1), F.floor(F.col("n") * p / 100)))
    placed = ranged(known.groupBy("k", "v").agg(F.count("*").alias("c")), ends)
    sums = placed.groupBy("k", "r").agg(F.sum("c").alias("s"), F.first("place").alias("place"))
    sums = sums.withColumn("upto", F.sum("s").over(W.partitionBy("k").orderBy("r"))).where(F.col("upto") >= F.col("place"))
    edge = sums.groupBy("k").agg(F.min(F.struct("r", (F.col("upto") - F.col("s")).alias("below"))).alias("x")).select(F.col("k").alias("k2"), F.col("x.r").alias("r2"), F.col("x.below").alias("below"))
    inner = placed.join(edge, F.col("k").eqNullSafe(F.col("k2")) & (F.col("r") == F.col("r2")))
    inner = inner.withColumn("upto", F.col("below") + F.sum("c").over(W.partitionBy("k").orderBy("v"))).where(F.col("upto") >= F.col("place"))
    return inner.groupBy(F.col("k").alias(key)).agg(F.min("v").alias(f"p{p}"))


def ranged(counted: DataFrame, ends: DataFrame) -> DataFrame:
    """Counted values (k, v, c) with the range (r) of their key's cuts that each falls into; a value that is itself a cut is the last of its range."""
    below = lambda of: F.size(F.filter(of, lambda x: x < F.col("v")))
    both = counted.join(ends.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k"))).drop("_k")
    coarse = F.array(*[F.element_at("cuts", i) for i in range(STRIDE, RANGES, STRIDE)])
    both = both.withColumn("r", STRIDE * below(coarse))
    return both.withColumn("r", F.col("r") + below(F.slice("cuts", F.col("r") + 1, STRIDE - 1)))


def best_of(hits: DataFrame, limit: int) -> DataFrame:
    """The best score of each event over several queries, then the top."""
    return hits.groupBy("event_id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "event_id").limit(limit)


def recall(probes: DataFrame) -> DataFrame:
    """One row: probes (hit boolean), how many, how many hit, and their share (no probes: 0)."""
    return probes.agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("recall"))


def retried(ask: Callable[[int], str], depth: int, abstained: Callable[[str], bool], factor: int = 3) -> tuple[str, int]:
    """An answer at ``depth`` and, if it abstains, once more from ``factor`` times as many events."""
    answer = ask(depth)
    return (ask(depth * factor), depth * factor) if abstained(answer) else (answer, depth)


def planned(question: str, planner: Callable[[str], tuple[list[str], str]] | None = None, most: int = 3) -> list[str]:
    """The question, at most ``most`` sub-queries of a host's planner, and its made-up answer, each once; a planner that fails leaves the question alone."""
    queries = [question]
    if planner is not None:
        try:
            parts, answer = planner(question)
        except Exception:  # a host's planner never breaks a search
            return queries
        queries += [q.strip() for q in [*parts[:most], answer] if q and q.strip()]
    return list(dict.fromkeys(queries))


def entity_boost(text: Column, entities: list[str]) -> Column:
    """1 and a tenth for each of the question's entities that the text names."""
    hits = sum((F.contains(F.lower(text), F.lit(e.lower())).cast("int") for e in entities), F.lit(0))
    return 1 + 0.1 * hits


def harness_tokens(text: Column) -> Column:
    """The harness's estimate: words over 0.75, rounded up."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.ceil(words / 0.75).cast("long")


def humanised(predicate: Column) -> Column:
    """R29."""
    return F.replace(predicate, F.lit("_"), F.lit(" "))


def dated_snippet(at: Column, text: Column) -> Column:
    """[yyyy-MM-dd] text."""
    return F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd"), F.lit("] "), text)


def retrieved(index, asked: DataFrame, limit: int | Column) -> DataFrame:
    """S5, T12 for many questions at once: (question_id, event_id, score, place) of each question's best events of its workstream.

    asked: question_id, workstream_id, query; several rows of a question are its planned queries, and an
    event counts by its best one. Terms meet the postings by term and workstream; statistics are of the
    workstream, which is a store of its own here.
    """
    from pyspark.sql import Window as W

    words = asked.withColumn("q", F.monotonically_increasing_id()).select("question_id", "workstream_id", "q", F.explode(terms(F.col("query"))).alias("term"))
    words = words.groupBy("question_id", "workstream_id", "q", "term").agg(F.count("*").alias("times"))
    size = index.documents.groupBy("workstream_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = index.cells.groupBy("term", "workstream_id").agg(F.sum("n").alias("df"))
    hits = words.join(df, ["term", "workstream_id"]).join(size, "workstream_id").join(index.postings.select("term", "workstream_id", "event_id", "tf", "dl"), ["term", "workstream_id"])
    add = F.col("times") * R.idf(F.col("n"), F.col("df")) * R.bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"))
    each = hits.groupBy("question_id", "q", "event_id").agg(F.sum(add).alias("score")).groupBy("question_id", "event_id").agg(F.round(F.max("score"), 9).alias("score"))
    place = F.row_number().over(W.partitionBy("question_id").orderBy(F.col("score").desc(), "event_id"))
    return each.withColumn("place", place).where(F.col("place") <= limit)


def contexts(found: DataFrame, events: DataFrame) -> DataFrame:
    """(question_id, context): the dated snippets of a question's events, best first."""
    lines = found.join(events.select("event_id", dated_snippet(F.col("valid_at"), F.col("content")).alias("line")), "event_id")
    return lines.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("context"))


def by_host(rows: DataFrame, ask: Callable[..., pd.Series], columns: list[str], kind: str, failed) -> Column:
    """A host's function on some columns, in Arrow batches; a batch that fails is tried row by row, and rows that fail again give ``failed``."""

    def run(*parts: pd.Series) -> pd.Series:
        try:
            return ask(*parts)
        except Exception:  # one bad question must not cost the others
            out = []
            for i in range(len(parts[0])):
                try:
                    out.append(ask(*(p.iloc[i : i + 1] for p in parts)).iloc[0])
                except Exception:
                    out.append(failed)
            return pd.Series(out)

    return F.pandas_udf(run, kind)(*[F.col(c) for c in columns])


def conversation_run(turns: DataFrame, questions: DataFrame, answerer: Callable[[pd.Series, pd.Series], pd.Series], judge: Callable[[pd.Series, pd.Series, pd.Series], pd.Series], depth: int = 20, done: DataFrame | None = None, planner: Callable[[str], tuple[list[str], str]] | None = None, retry: bool = True) -> tuple[DataFrame, DataFrame]:
    """(graded, report) of a chat corpus: index the turns, retrieve for each question, let a host answer and judge, aggregate.

    turns: sample_id, session, at, turn, speaker, text; questions: sample_id, number, question, answer,
    category (``sources.files.chat_corpus``). ``answerer`` takes questions and contexts, ``judge`` takes
    questions, gold answers and predictions; both get Arrow batches. An answer that abstains is asked for
    once more from three times as many events and kept if it does not abstain then (T13). ``done`` has
    graded rows of an earlier run, which are not asked again (S16). ``planner`` gives sub-queries (X9). A
    host that fails on a question gives ``[error]`` and a wrong answer. Graded rows are computed each
    time they are read: write them before the report where a host's calls cost money.
    """
    from .textindex import indexed

    events = turns.select(F.format_string("%s-s%05d-t%05d", "sample_id", "session", "turn").alias("event_id"), F.col("sample_id").alias("workstream_id"), F.col("at").cast("timestamp_ntz").alias("created_at"), F.col("at").alias("valid_at"), F.concat_ws(": ", "speaker", "text").alias("content"))
    index = indexed(events)
    rows = questions if done is None else questions.join(done.select("sample_id", "number"), ["sample_id", "number"], "left_anti")
    rows = rows.withColumn("question_id", F.concat_ws("#", "sample_id", F.col("number").cast("string")))
    plan = F.udf(lambda q: planned(q, planner), "array<string>") if planner else F.array
    asked = rows.select("question_id", F.col("sample_id").alias("workstream_id"), F.explode(plan(F.col("question"))).alias("query"))

    def answered(of: DataFrame, deep: int) -> DataFrame:
        some = asked.join(of.select("question_id"), "question_id", "left_semi")
        context = contexts(retrieved(index, some, deep), events)
        out = of.join(context, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        return out.withColumn("predicted", by_host(out, answerer, ["question", "context"], "string", "[error]"))

    first = answered(rows, depth)
    if retry:
        again = answered(first.where(abstains(F.col("predicted"))).select(*rows.columns), 3 * depth).where(~abstains(F.col("predicted")))
        again = again.select("question_id", F.col("context").alias("wider"), F.col("predicted").alias("then"))
        first = first.join(again, "question_id", "left").withColumn("context", F.coalesce("wider", "context")).withColumn("predicted", F.coalesce("then", "predicted"))
    graded = first.withColumn("said", by_host(first, judge, ["question", "answer", "predicted"], "boolean", False))
    graded = graded.withColumn("correct", F.col("said") & (F.col("predicted") != "[error]")).withColumn("tokens", harness_tokens(F.col("context")))
    graded = graded.select("sample_id", "number", "category", "question", "answer", "predicted", "correct", "tokens", gold_support(F.col("context"), F.col("answer")).alias("gold_in_context"))
    graded = graded if done is None else graded.unionByName(done.select(*graded.columns))
    return graded, accuracy(graded)
