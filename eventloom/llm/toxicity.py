"""Toxicity (operator 12): a hashed linear classifier, regularised by counterfactual pairs.

Labelled sentences that mention a group are paired with the same sentences in which another term of the
same kind, or none, stands for the mention. The score is linear, so a pair's change of score is the
weights' product with the difference of its features; the fit penalises the mean squared change
(counterfactual logit pairing). A group that the toxic examples happen to name more often than the
others therefore gets no weight of its own, and neutral mentions are not marked.

The fit takes a bounded sample of labelled rows. Tasks count features by label, the features with a
clear side are chosen in Spark (at most ``CHOSEN``), and only these, packed, and the distinct differences of
the pairs with their counts go to the driver: its memory is bounded by SAMPLE * CHOSEN whatever the
length of the texts. All texts are then scored whole, in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, cut, fresh, schema, table
from .hashing import PUNCTUATION, U, mix, split_words, steps, word_heads

#: Labelled rows that the fit takes, those with the least hash of doc_id; features it may use; distinct pairs it may weigh.
SAMPLE, CHOSEN, PAIRS = 20_000, 4096, 20_000
#: Hashed features; a feature also counts as held at least 2, 4 and 8 times.
DIM, TIMES = 1 << 18, (1, 2, 4, 8)
HEADS = (4, 5, 6, 7)
#: Weight of the pairs' mean squared change of score, and of the squared weights, in the loss.
PAIRING, RIDGE = 30.0, 0.02
#: Bytes that end a sentence.
ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))
#: The single-word identity terms of Dixon et al., Measuring and Mitigating Unintended Bias in Text Classification (2018), by kind.
IDENTITIES = {
    "orientation": ("lesbian", "gay", "bisexual", "queer", "lgbt", "lgbtq", "homosexual", "straight", "heterosexual"),
    "gender": ("male", "female", "nonbinary", "transgender", "trans"),
    "origin": ("african", "black", "white", "european", "hispanic", "latino", "latina", "latinx", "mexican", "canadian", "american", "asian", "indian", "chinese", "japanese"),
    "religion": ("christian", "muslim", "jewish", "buddhist", "catholic", "protestant", "sikh", "taoist"),
    "age": ("old", "older", "young", "younger", "teenage", "millenial", "elderly"),
    "disability": ("blind", "deaf", "paralyzed"),
}


def two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring words."""
    return mix(a * U(3) ^ mix(b))


def slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> U(20)) % U(DIM)).astype(np.int64)


class Terms:
    """The identity terms as hashes, each with its features and those of the terms that may stand for it."""

    def __init__(self, identities: dict[str, tuple[str, ...]]):
        words = [(kind, w) for kind, terms in identities.items() for w in terms]
        raw = np.frombuffer(" ".join(w for _, w in words).encode(), np.uint8)
        w = split_words(raw, np.array([0, len(raw)]), True, PUNCTUATION)
        heads = [word_heads(raw, w, n, True) + U(n) for n in HEADS]
        self.own = {int(h): [int(h), *(int(x[i]) for x in heads)] for i, h in enumerate(w.hash)}
        kinds = np.array([k for k, _ in words])
        self.others = {int(h): [int(x) for x in w.hash[kinds == kinds[i]] if x != h] for i, h in enumerate(w.hash)}
        self.hash = np.sort(w.hash)

    def mentions(self, raw: np.ndarray, w) -> Iterator[tuple[int, int, int]]:
        """(term, word before, word after) of each mention; 0 where the sentence ends."""
        at = np.flatnonzero(np.isin(w.hash, self.hash))
        ends = np.r_[0, np.cumsum(ENDS[raw])]
        document = np.searchsorted(w.first, at, side="right")
        for p, d in zip(at.tolist(), document.tolist(), strict=True):
            before = p > w.first[d - 1] and ends[w.start[p]] == ends[w.end[p - 1]]
            after = p + 1 < w.first[d] and ends[w.start[p + 1]] == ends[w.end[p]]
            yield int(w.hash[p]), int(w.hash[p - 1]) if before else 0, int(w.hash[p + 1]) if after else 0

    def swaps(self, term: int, before: int, after: int) -> Iterator[list[tuple[int, int]]]:
        """For each counterpart, none included, the features that the mention gains (1) or loses (-1)."""
        for other in [*self.others[term], 0]:
            change = []
            for t, sign in ((term, 1), (other, -1)):
                if t:
                    held = np.array(self.own[t], U)
                    pairs = [two(*(np.array([x], U) for x in p)) for p in ((before, t), (t, after)) if 0 not in p]
                    change += [(int(s), sign) for s in slots(np.concatenate([held, *pairs]))]
            yield change


def held_features(raw: np.ndarray, w, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, times) of some documents' words, heads and pairs of words; chosen: the features to look at."""
    document = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    inner = np.flatnonzero(document[1:] == document[:-1])
    parts = [(document, w.hash), *((document, word_heads(raw, w, n, True) + U(n)) for n in HEADS), (document[inner], two(w.hash[inner], w.hash[inner + 1]))]
    codes = []
    for d, h in parts:
        s = slots(h)
        keep = slice(None) if chosen is None else chosen[s]
        codes.append(d[keep] * DIM + s[keep])
    code, times = np.unique(np.concatenate(codes), return_counts=True)
    return code // DIM, code % DIM, times


def documents(batch: pa.RecordBatch, text: str):
    for a, b, raw, offsets in steps(batch.column(text)):
        yield slice(a, b), raw, split_words(raw, offsets, True, PUNCTUATION)


def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents, toxic documents) of a task's labelled rows; a feature's number also says how often it is held."""
    seen, bad = np.zeros((len(TIMES), DIM), np.int64), np.zeros((len(TIMES), DIM), np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for rows, raw, w in documents(batch, "text"):
            d, f, n = held_features(raw, w)
            for i, least in enumerate(TIMES):
                k = n >= least
                seen[i] += np.bincount(f[k], minlength=DIM)
                bad[i] += np.bincount(f[k], toxic[rows][d[k]], minlength=DIM).astype(np.int64)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, seen.ravel()[at], bad.ravel()[at])], names=["feature", "seen", "bad"])


class Places:
    """Numbers of the chosen features (0, 1, ...) by feature and times held."""

    def __init__(self, features: list[int]):
        self.number = np.full((len(TIMES), DIM), -1, np.int32)
        self.number.ravel()[features] = np.arange(len(features))
        self.any = (self.number >= 0).any(axis=0)

    def of(self, raw: np.ndarray, w) -> tuple[np.ndarray, np.ndarray]:
        """(document, number) for each chosen feature that a document holds."""
        d, f, n = held_features(raw, w, self.any)
        found = [(d[k], self.number[i, f[k]]) for i, least in enumerate(TIMES) for k in [n >= least]]
        d, f = (np.concatenate(x) for x in zip(*found, strict=True))
        return d[f >= 0], f[f >= 0]


def chosen_features(places: Places):
    def run(batches):
        for batch in batches:
            out = []
            for rows, raw, w in documents(batch, "text"):
                d, f = places.of(raw, w)
                order = np.lexsort((f, d))
                edge = np.searchsorted(d[order], np.arange(rows.stop - rows.start + 1))
                out += [f[order][a:b].astype("<u2").tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("toxic"), pa.array(out, pa.binary())], names=["order", "toxic", "held"])

    return run


def pair_changes(places: Places, terms: Terms):
    """(change, n): the chosen features that a swap takes away or brings, as signed numbers from 1, with the number of such swaps in a task's rows."""

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for _, raw, w in documents(batch, "text"):
                for mention, n in Counter(terms.mentions(raw, w)).items():
                    for change in terms.swaps(*mention):
                        for number in places.number:  # held once, twice, ...
                            total: Counter = Counter()
                            for slot, sign in change:
                                if number[slot] >= 0:
                                    total[int(number[slot])] += sign
                            key = ",".join(str(f + 1 if s > 0 else -f - 1) for f, s in sorted(total.items()) for _ in range(abs(s)))
                            if key:
                                found[key] += n
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["change", "n"])

    return run


def fitted(held: list[np.ndarray], y: np.ndarray, lift: np.ndarray, pairs: list[tuple[np.ndarray, int]], pairing: float, rounds: int = 400, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on features scaled by their log odds, with the pairs' changes of score penalised."""
    row, col = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64)
    value = lift[col]
    of, what = np.repeat(np.arange(len(pairs)), [len(c) for c, _ in pairs]), np.concatenate([*(c for c, _ in pairs), np.zeros(0, np.int64)]).astype(np.int64)
    sign, what = np.sign(what), np.abs(what) - 1
    change, share = sign * lift[what], np.array([n for _, n in pairs], float)
    share /= max(1.0, share.sum())
    w, bias, n, size = np.full(len(lift), 0.2), -1.0, max(1, len(y)), len(lift)
    gw, gb = np.full(size, 1e-2), 1e-4
    for _ in range(rounds if len(y) else 0):
        z = np.bincount(row, value * w[col], minlength=len(y)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = RIDGE * w / n + np.bincount(col, value * d[row], minlength=size)
        if len(pairs):
            moved = np.bincount(of, change * w[what], minlength=len(pairs))
            g = g + 2 * pairing * np.bincount(what, change * (share * moved)[of], minlength=size)
        gw, gb = gw + g * g, gb + d.sum() ** 2
        w, bias = w - rate * g / np.sqrt(gw), bias - rate * d.sum() / np.sqrt(gb)
    return w * lift, float(bias)


def learned(docs: DataFrame, labels: DataFrame, identities: dict[str, tuple[str, ...]] = IDENTITIES, pairing: float = PAIRING, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights (times held, feature) and bias. docs: doc_id, text; labels: doc_id, toxic (1 or 0; null: no label; repeated rows: the worst counts)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    gold = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    picked = gold.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = spark.createDataFrame(picked.select("doc_id", "toxic").collect(), gold.schema)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = cut(rows.select(F.xxhash64("doc_id", "text").alias("order"), "toxic", "text"))
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return np.zeros((len(TIMES), DIM), np.float32), -3.0
    counted = rows.select("toxic", "text").mapInArrow(feature_counts, schema("feature long, seen long, bad long")).groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("seen") - F.col("bad") + 0.5) / (n - bad + 1))
    due = F.col("seen") * (bad / n)
    side = F.pow(F.col("bad") - due, 2) / F.greatest(due, F.lit(0.1))
    clear = counted.withColumn("odds", odds).withColumn("side", side).where("seen >= 5 and abs(odds) > 0.7 and side > 9")
    chosen = clear.orderBy(F.desc("side"), "feature").limit(CHOSEN).select("feature", "odds").collect()
    places = Places([r["feature"] for r in chosen])
    got = rows.mapInArrow(chosen_features(places), schema("order long, toxic long, held binary")).collect()
    got.sort(key=lambda r: (r["order"], r["toxic"]))
    pairs = rows.select("text").mapInArrow(pair_changes(places, Terms(identities)), schema("change string, n long")).groupBy("change").agg(F.sum("n").alias("n"))
    pairs = pairs.orderBy(F.desc("n"), "change").limit(PAIRS).collect()
    held = [np.frombuffer(bytes(r["held"]), "<u2") for r in got]
    w, bias = fitted(held, np.array([r["toxic"] for r in got], float), np.array([r["odds"] for r in chosen], float), [(np.array(r["change"].split(","), np.int64), r["n"]) for r in pairs], pairing)
    weights = np.zeros((len(TIMES), DIM), np.float32)
    weights.ravel()[[r["feature"] for r in chosen]] = w
    return weights, bias


def scores(weights: np.ndarray, bias: float, text: str, score: str):
    """Every batch with the score of its texts as one more column."""
    any_, add = (weights != 0).any(axis=0), np.cumsum(weights, axis=0)
    steps_ = np.array(TIMES)

    def run(batches):
        for batch in batches:
            out = [np.zeros(0)]
            for rows, raw, w in documents(batch, text):
                d, f, n = held_features(raw, w, any_)
                z = bias + np.bincount(d, add[np.searchsorted(steps_, n, side="right") - 1, f], minlength=rows.stop - rows.start)
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*batch.schema.names, score])

    return run


def held_out_rows(key: Column, folds: int = 5) -> Column:
    """Whether the checksum of the key as text falls in the first fold; a null key never does."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, identities: dict[str, tuple[str, ...]] = IDENTITIES, pairing: float = PAIRING, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text) with score, the probability of label 1; all columns stay, and a clash gets a leading underscore.

    Null and empty texts have no features and get the bias alone; texts of any length are scored whole.
    Every row is scored by its text, so repeated rows agree and null ids do no harm (they cannot have
    labels). Without usable labels every score is alike and low. An empty table gives no rows.
    """
    text, score = fresh(docs, "scored_text", "score")
    weights, bias = learned(docs, labels, identities, pairing, sample)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias(text))
    out = whole.mapInArrow(scores(weights, bias, text, score), T.StructType([*whole.schema.fields, T.StructField(score, T.DoubleType())]))
    return out.select("row.*", score)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = toxicity_scores(docs, labels.where(~held_out_rows(F.col("doc_id"))))
    return out.select("doc_id", held_out_rows(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
