"""Mixing sources to target weights (operator 5): Pareto order sampling over certain whole copies.

A source's target in words divided by its size gives its number of passes f. Every document first gets
floor(f) whole copies. The rest of the target is drawn with unequal probabilities p = scale * measure:
documents whose p would reach 1 are certain and taken first, and the scale of the others is found from
what is left, so that none of them is certain. The others are drawn by Pareto order sampling: they
are ranked by their random odds u / (1 - u) over their inclusion odds p / (1 - p), and taken from the
lowest rank until the words that are left are filled. A document that does not fit is skipped, and the
drawing goes on in rank order until none fits. Then one more, whose size comes nearest to what is still
missing, is taken if that brings the source nearer to its target. Random numbers are a hash of seed and
doc_id, so reruns agree.

No source is ever sorted in one task: ranks are cut into ranges, the sums of the ranges find the one
that holds the boundary, that range is cut again, and only its rows are put in order. This is repeated
for the documents that are left and fit, with the rest of the need, until that is small; then one fold
over a bounded number of documents ends the drawing. What a round decides is a few numbers
for each source, so every document knows from its own row whether it is drawn: nothing joins by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, few, fresh, table, word_count

#: Ranges that ranks are cut into, twice.
RANGES = 2048
#: Words that a source may still need when the rest of its drawing is done in one fold.
FOLD = 1024
#: Up to so many sources their few numbers each are broadcast; beyond, Spark joins them by their size.
SOURCES = 100_000
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all words by weight, none above ``most`` times its source, the excess shared again.

    Sources in code-point order, null last, take the weights in turn. Sorted by the level at which
    they fill up, a source is full if what the fuller ones leave, spread by weight, exceeds its cap.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sums.withColumn("w", cycle).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = W.partitionBy()
    before = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = capped.withColumn("level", left / weight).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    level = level.withColumn("final", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w")))
    return level.select("source", "source_size", target.alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 for each key."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def boundary(rows: DataFrame, need: DataFrame, place: Column) -> DataFrame:
    """For each source the range that its cumulative size first exceeds ``need`` in, and what is needed within it."""
    sums = rows.withColumn("range", place).groupBy("source", "range").agg(F.sum("size").alias("s"))
    cum = F.sum("s").over(W.partitionBy("source").orderBy("range"))
    over = sums.withColumn("cum", cum).join(need.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).where("cum > need")
    first = over.groupBy("source").agg(F.min(F.struct("range", (F.col("need") - F.col("cum") + F.col("s")).alias("need"))).alias("x"))
    return first.select("source", F.col("x.range").alias("range"), F.col("x.need").alias("need"))


def edges_of(rows: DataFrame, need: DataFrame) -> DataFrame:
    """(of, b1, b2, need2): for each source whose rows exceed ``need``, the range of ranges that holds the boundary, and what is needed within it."""
    level1 = boundary(rows, need, F.col("r1")).select(F.col("source").alias("of"), F.col("range").alias("b1"), "need")
    inner = rows.join(level1, F.col("source").eqNullSafe(F.col("of")) & (F.col("r1") == F.col("b1")))
    need2 = level1.select(F.col("of").alias("source"), "need")
    level2 = boundary(inner.select("source", "size", "r2"), need2, F.col("r2")).select(F.col("source").alias("of2"), F.col("range").alias("b2"), F.col("need").alias("need2"))
    return cut(level1.join(level2, F.col("of").eqNullSafe(F.col("of2"))).select("of", "b1", "b2", "need2"))


def scales(base: DataFrame, need: DataFrame) -> DataFrame:
    """(of, scale): inclusion probabilities are least(1, scale * weight), and the expected words of a source are its need.

    base: source, size, weight; need: source, need. If all rows above some weight are certain, the scale
    is what is left of the need over the measure of the others; the first weight that this scale leaves
    below certainty is the right one. Weights are rounded (``rounded``), so a source has a bounded number.
    """
    sums = base.where("weight > 0").groupBy("source", "weight").agg(F.sum("size").alias("s")).withColumn("m", F.col("s") * F.col("weight"))
    sums = sums.join(few(need.select(F.col("source").alias("of"), "need"), SOURCES), F.col("source").eqNullSafe(F.col("of")))
    above = W.partitionBy("source").orderBy(F.col("weight").desc()).rowsBetween(W.unboundedPreceding, -1)
    below = W.partitionBy("source").orderBy(F.col("weight").desc()).rowsBetween(0, W.unboundedFollowing)
    tried = sums.withColumn("scale", F.try_divide(F.col("need") - F.coalesce(F.sum("s").over(above), F.lit(0)), F.sum("m").over(below)))
    right = tried.where("scale * weight < 1").groupBy("of").agg(F.max_by("scale", "weight").alias("scale"))
    return need.select(F.col("source").alias("of")).join(right.withColumnRenamed("of", "r"), F.col("of").eqNullSafe(F.col("r")), "left").select("of", F.coalesce("scale", F.lit(1e300)).alias("scale"))


def rounded(weight: Column) -> Column:
    """A size measure to one part in about 1,500, so that a source has a bounded number of different ones."""
    return F.when(weight > 0, F.pow(F.lit(2.0), F.round(F.log2(weight) * 1024) / 1024)).otherwise(F.lit(0.0))


def mix(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 17, preference: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, and the columns of ``keep``) for each document.

    docs: key and source; ``size`` is a column of whole numbers (null: 0) in words or other units.
    ``preference`` is the size measure of the inclusion probabilities (default: the square root of the
    size, so that longer documents are likelier); null, zero and negative ones are never drawn. A source
    of size 0 takes nothing. Rows that repeat a key are drawn together or not at all. A null key is a key.
    An empty table gives no rows. ``keep`` must not clash with the names above.
    """
    measure = rounded(F.sqrt(F.col("size").cast("double")) if preference is None else F.coalesce(preference.cast("double"), F.lit(0.0)))
    plain = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), uniform(F.coalesce(F.col(key).cast("string"), F.lit("")), seed).alias("u"), *([] if preference is None else [measure.alias("weight")]), *keep)
    plain = plain.withColumn("weight", measure) if preference is None else plain
    base = cut(plain.drop(*keep))
    aims = targets(base.select("source", "size"), weights, share, most)
    aims = aims.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("long"))
    # sizes are whole, so what is needed may be, too: sums stay exact
    aims = cut(aims.withColumn("need", F.floor(F.col("target") - F.col("whole") * F.col("source_size"))))
    found = few(cut(scales(base, aims.select("source", "need"))), SOURCES)

    def ranked(rows: DataFrame) -> DataFrame:
        """rows with q: 0 for what is certain, infinite for what is never drawn."""
        p = F.col("scale") * F.col("weight")
        odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
        return rows.join(found, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("q", F.when(p >= 1, F.lit(0.0)).when(p > 0, odds).otherwise(F.lit(float("inf")))).drop("of", "scale", "u", "weight")

    place = F.when(F.col("q") == float("inf"), F.lit(RANGES - 1e-6)).otherwise(F.col("q") / (1 + F.col("q")) * RANGES)
    state = ranked(base).where(F.col("q") < float("inf"))
    state = cut(state.withColumn("r1", F.floor(place)).withColumn("r2", F.floor((place - F.floor(place)) * RANGES)))
    left, turns, open_ = cut(aims.select("source", F.col("need").cast("long").alias("need"))), [], True
    while open_ and (left.agg(F.max("need")).first()[0] or 0) > FOLD:
        lack = left.select(F.col("source").alias("for"), "need")
        fits = state.join(lack, F.col("source").eqNullSafe(F.col("for"))).where((F.col("need") >= 1) & F.col("size").between(1, F.col("need"))).drop("for", "need")
        edges = edges_of(fits, left)
        placed = fits.join(edges, F.col("source").eqNullSafe(F.col("of")), "left")
        at = (F.col("r1") == F.col("b1")) & (F.col("r2") == F.col("b2"))
        exact = placed.where(at).withColumn("cum", F.sum("size").over(W.partitionBy("source").orderBy("q", "doc_id"))).where("cum <= need2")
        last = exact.groupBy("source").agg(F.max(F.struct("q", "doc_id")).alias("last")).withColumnRenamed("source", "lo")
        # a source's turn: up to which size and rank documents are drawn; without an edge all that fit, without a last one those before the range
        turn = lack.join(edges, F.col("for").eqNullSafe(F.col("of")), "left").join(last, F.col("for").eqNullSafe(F.col("lo")), "left").drop("of", "lo", "need2")
        turn = cut(turn.where("need >= 1").select(F.col("for").alias("of"), F.struct("need", "b1", "b2", F.col("last.q").alias("q"), F.col("last.doc_id").alias("id")).alias("turn")))
        turns.append(turn)
        state = state.join(turn, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("drawn", F.coalesce(drawn_in(F.col("turn")), F.lit(False)))
        state = cut(state.drop("of", "turn"))
        got = state.where("drawn").groupBy("source").agg(F.sum("size").alias("got")).withColumnRenamed("source", "of")
        left = cut(left.join(got, F.col("source").eqNullSafe(F.col("of")), "left").select("source", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"), F.col("got").isNotNull().alias("open")))
        open_ = bool(left.where("open").take(1))
        state, left = state.where(~F.col("drawn")).drop("drawn"), left.drop("open")
    picks = cut(last_draws(state, left))
    left = left.join(picks, F.col("source").eqNullSafe(F.col("ps")), "left").select("source", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"))
    state = state.join(few(picks, SOURCES), F.col("source").eqNullSafe(F.col("ps")), "left").where(~picked()).drop("ps", "got", "picks")

    # nothing fits any more: one document may still come nearer by overshooting
    gap = left.select(F.col("source").alias("of"), F.col("need").alias("gap")).where("gap >= 1")
    miss = F.abs(F.col("size") - F.col("gap"))
    closing = state.join(gap, F.col("source").eqNullSafe(F.col("of"))).where(miss < F.col("gap"))
    closing = closing.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "q", "doc_id")).alias("x")).select(F.col("source").alias("cs"), F.col("x.q").alias("cq"), F.col("x.doc_id").alias("cid"))
    kind = "struct<i:int,need:bigint,b1:bigint,b2:bigint,q:double,id:" + base.schema["doc_id"].dataType.simpleString() + ">"
    none = aims.where(F.lit(False)).select(F.col("source").alias("of"), F.lit(None).cast(kind).alias("turn"))
    numbered = reduce(DataFrame.union, [t.select("of", F.struct(F.lit(i).alias("i"), "turn.*").cast(kind).alias("turn")) for i, t in enumerate(turns)], none)
    plan = aims.select(F.col("source").alias("as"), "source_size", "target", "whole").join(numbered.groupBy("of").agg(F.array_sort(F.collect_list("turn")).alias("turns")), F.col("as").eqNullSafe(F.col("of")), "left")
    plan = plan.drop("of").join(picks.drop("got"), F.col("as").eqNullSafe(F.col("ps")), "left").drop("ps")
    plan = cut(plan.join(closing, F.col("as").eqNullSafe(F.col("cs")), "left").drop("cs"))

    out = ranked(plain).withColumn("r1", F.floor(place)).withColumn("r2", F.floor((place - F.floor(place)) * RANGES))
    out = out.join(few(plan, SOURCES), F.col("source").eqNullSafe(F.col("as")))
    closes = F.coalesce(F.col("cq").eqNullSafe(F.col("q")) & F.col("cid").eqNullSafe(F.col("doc_id")) & F.col("cq").isNotNull(), F.lit(False))
    drawn = (F.col("q") < float("inf")) & (F.coalesce(F.exists("turns", lambda t: F.coalesce(drawn_in(t), F.lit(False))), F.lit(False)) | picked() | closes)
    out = out.withColumn("copies", (F.col("whole") + drawn.cast("int")).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def last_draws(state: DataFrame, left: DataFrame) -> DataFrame:
    """(ps, got, picks): the rest of the drawing in rank order, for sources that need at most ``FOLD`` words: what is taken, and the (q, id) drawn.

    Of documents of c words only the first need / c can still fit, so the fold sees a number of
    documents that ``FOLD`` bounds, however many a source has.
    """
    lack = left.where(F.col("need").between(1, FOLD)).select(F.col("source").alias("for"), "need")
    fits = state.join(lack, F.col("source").eqNullSafe(F.col("for"))).where(F.col("size").between(1, F.col("need")))
    alike = W.partitionBy("source", "size").orderBy("q", "doc_id")
    fits = fits.withColumn("n", F.row_number().over(alike)).where((F.col("n") <= FOLD) & (F.col("n") * F.col("size") <= F.col("need")))
    by = fits.groupBy("source").agg(F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("q", F.col("doc_id").alias("id"), "size"))).alias("x"))
    kind = state.schema["doc_id"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("bigint").alias("got"), F.array().cast(f"array<struct<q:double,id:{kind}>>").alias("picks"))

    def step(acc, x):
        fit = acc["got"] + x["size"] <= F.col("need")
        return F.struct((acc["got"] + F.when(fit, x["size"]).otherwise(F.lit(0))).alias("got"), F.when(fit, F.concat(acc["picks"], F.array(F.struct(x["q"].alias("q"), x["id"].alias("id"))))).otherwise(acc["picks"]).alias("picks"))

    return by.select(F.col("source").alias("ps"), F.aggregate("x", start, step).alias("a")).select("ps", "a.got", "a.picks")


def picked() -> Column:
    return F.coalesce(F.exists("picks", lambda x: (x["q"] == F.col("q")) & x["id"].eqNullSafe(F.col("doc_id"))), F.lit(False))


def drawn_in(turn: Column) -> Column:
    """Whether a turn (need, b1, b2, q, id) draws a row (size, q, r1, r2, doc_id) that is still there: it fits, and lies before the edge or in its range up to the last one."""
    b1, b2, r1, r2, q = turn["b1"], turn["b2"], F.col("r1"), F.col("r2"), F.col("q")
    below = b1.isNull() | (r1 < b1) | ((r1 == b1) & (r2 < b2))
    last = (r1 == b1) & (r2 == b2) & ((q < turn["q"]) | ((q == turn["q"]) & (F.col("doc_id").eqNullSafe(turn["id"]) | F.coalesce(F.col("doc_id") < turn["id"], F.col("doc_id").isNull()))))
    return F.col("size").between(1, turn["need"]) & (below | F.coalesce(last, F.lit(False)))


def mixed_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the mix takes, each once: docs' columns and how many copies of each. A document without words comes in whole copies only."""
    (copies,) = fresh(docs, "copies")
    whole = docs.select(F.col("doc_id"), F.col("source"), F.col(text), F.struct(*docs.columns).alias("_row"))
    out = mix(whole, word_count(F.col(text)), keep=("_row",)).where("copies > 0")
    return out.select("_row.*", F.col("copies").alias(copies))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), word_count(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
