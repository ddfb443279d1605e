"""Quality classifier (operator 9): a weak-label model over heuristic labellers, then a hashed linear scorer.

Two questions are asked of a document: is it junk, is it toxic. For each, several labellers vote bad,
good or nothing. The votes of all documents are written once and counted by pattern (a bounded table),
and expectation-maximisation on those counts estimates each labeller's accuracies and, from them, the
posterior label of each pattern; bad documents may be of several kinds. Human labels, where there are
any, are one more labeller. The
posterior labels of a bounded sample of all documents, with and without human labels, train a linear
scorer over hashed words and word heads, which then scores every document. A first scorer, fitted where
people have judged (nowhere: on the whole sample), adds its evidence to the other documents' posteriors.

Junk labellers: capitals, symbols, repeated neighbours, variety, and word lengths (rules of the kind that
published web-corpus filters use). Toxic labellers: lexicons learned from the human labels of one part of
the documents each, which vote on the other parts, so that no lexicon votes on what it was learned from;
and any word lists that the caller passes. The library has none of its own: without labels and lists
nothing is known of toxicity and only junk is judged.

The sampled documents' features stay in a written table. Spark sums them by feature; what the driver
holds is at most ``FEATURES`` numbers for each sampled document, however long the texts are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, cut, fresh, schema, table
from .hashing import PUNCTUATION, U, Words, split_words, steps, word_heads
from .near import pack, unpack

#: The scorer is fitted on at most this many documents with human labels and as many without, those with the least hash of doc_id.
SAMPLE = 4000
#: Hashed features.
DIM = 1 << 18
HEADS = (4, 6)
#: Features that a scorer uses at most, those that tell bad from good documents best; only these ever reach the driver.
FEATURES = 1 << 12
#: Lexicons learned from human labels, each from its own part of the labelled documents. With two, no document gets two of their votes, which would not be independent.
PARTS = 2
#: A feature is in a lexicon if at least this share of the part's documents that hold it are bad, the share of cases in which people are taken to be right.
LEXICON_SHARE = 0.9
#: Fixed point of the labels that are summed in Spark: sums of whole numbers are the same in any order.
UNIT = 1 << 20
#: Symbols that running prose does without, and the share of characters from which a text is full of them.
SYMBOLS, SYMBOL_SHARE = b"#$%&*+/<=>@[]^_`{|}~\\", 0.02
#: Shares from which capitals and repeated neighbours are too many; distinct words of up to so many words.
CAPITALS, REPEATS, VARIETY, VARIETY_WORDS = 0.3, 0.2, (0.3, 0.5), 1000
#: Mean word lengths outside this range are odd.
WORD_LENGTH = (3.0, 10.0)
STATS = ("shout", "noise", "repeat", "plain")
JUNK_VOTES = ("j_shout", "j_noise", "j_repeat", "j_variety", "j_length")
Lists = tuple[tuple[str, ...], ...]


def toxic_votes(lists: Lists) -> tuple[str, ...]:
    return (*(f"t_list{i}" for i in range(len(lists))), *(f"t_lexicon{i}" for i in range(PARTS)))


def hashes_of(words: tuple[str, ...]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(split_words(raw, np.array([0, len(raw)]), True, PUNCTUATION).hash)


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    return total[first[1:]] - total[first[:-1]]


def features(raw: np.ndarray, w: Words) -> np.ndarray:
    """A row of feature numbers for each word: itself and its heads."""
    cols = [w.hash, *(word_heads(raw, w, n, True) + U(n) for n in HEADS)]
    return np.stack([(c >> U(20)) % U(DIM) for c in cols], axis=1).astype(np.int64)


def present(rows: np.ndarray) -> np.ndarray:
    """A document's features: what it holds, and what it holds at least 2, 4 and 8 times."""
    k, c = np.unique(rows, return_counts=True)
    return np.concatenate([k, *((k[c >= t] + t * 0x9E3779B1) % DIM for t in (2, 4, 8))])


def statistics(raw: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
    """Shares per document: capitals of ASCII letters, noise characters, repeated neighbours, distinct words."""
    upper = per_document((raw >= 0x41) & (raw <= 0x5A), offsets)
    lower = per_document((raw >= 0x61) & (raw <= 0x7A), offsets)
    noise = per_document(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)), offsets)
    n = np.maximum(1, np.diff(w.first))
    same = np.r_[w.hash[1:] == w.hash[:-1], False] if len(w.hash) else np.zeros(0, bool)
    repeat = per_document(same, w.first)
    distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)])
    return np.stack([upper / np.maximum(1, upper + lower), noise / np.maximum(1, np.diff(offsets)), repeat / n, distinct / n], axis=1)


def documents_of(batch: pa.RecordBatch):
    ids = batch.column("doc_id").to_pylist()
    for a, b, raw, offsets in steps(batch.column("text")):
        w = split_words(raw, offsets, True, PUNCTUATION)
        yield ids[a:b], raw, offsets, w, np.diff(w.first)


def sample_features(batches):
    """(doc_id, number of features, the features as packed differences, statistics) of the documents to learn from."""
    for batch in batches:
        rows = []
        for ids, raw, offsets, w, n in documents_of(batch):
            f, stats = features(raw, w), statistics(raw, offsets, w)
            for i, d in enumerate(ids):
                k = np.sort(present(f[w.first[i] : w.first[i + 1]]))
                rows.append((d, len(k), pack(np.diff(k, prepend=0), 4), stats[i].tolist()))
        if rows:
            d, n, k, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.binary()), pa.array(s, pa.list_(pa.float64()))], names=["doc_id", "n", "k", "stats"])


def votes(lexicons: list[np.ndarray], lists: list[np.ndarray]):
    """(doc_id, votes of the labellers that look at the text): 1 bad, 0 good, null nothing."""
    names = ["doc_id", *JUNK_VOTES, *toxic_votes(tuple(lists))]

    def run(batches):
        for batch in batches:
            for ids, raw, offsets, w, n in documents_of(batch):
                s = statistics(raw, offsets, w)
                enough, all_ = n >= 5, np.ones(len(n), bool)
                f = features(raw, w)
                held = [present(f[x:y]) for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
                length = per_document(w.end - w.start, w.first) / np.maximum(1, n)
                say = lambda bad, known: pa.array(bad.astype(np.int8), pa.int8(), mask=~known)
                clear = enough & (n <= VARIETY_WORDS) & ((s[:, 3] < VARIETY[0]) | (s[:, 3] > VARIETY[1]))
                junk = [say(s[:, 0] > CAPITALS, enough), say(s[:, 1] > SYMBOL_SHARE, enough), say(s[:, 2] > REPEATS, enough), say(s[:, 3] < VARIETY[0], clear), say((length < WORD_LENGTH[0]) | (length > WORD_LENGTH[1]), enough)]
                toxic = [say(per_document(np.isin(w.hash, words), w.first) > 0, all_) for words in lists]
                toxic += [say(np.array([lexicon[k].sum() for k in held]) > 0, enough & lexicon.any()) for lexicon in lexicons]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *junk, *toxic], names=names)

    return run


def scores(weights: dict[str, tuple[np.ndarray, np.ndarray, float]], texts: str = "text"):
    """Every batch with p_junk and p_toxic of its texts as two more columns."""

    def run(batches):
        for batch in batches:
            found = [np.zeros(0), np.zeros(0)]
            for _, _, raw, offsets in steps(batch.column(texts)):
                w = split_words(raw, offsets, True, PUNCTUATION)
                f, s = features(raw, w), inputs(statistics(raw, offsets, w))
                held = [present(f[x:y]) for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
                for i, name in enumerate(("junk", "toxic")):
                    hashed, plain, bias = weights[name]
                    z = np.array([hashed[x].sum() for x in held]) + s @ plain + bias
                    found[i] = np.r_[found[i], 1 / (1 + np.exp(-np.clip(z, -30, 30)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=[*batch.schema.names, "p_junk", "p_toxic"])

    return run


def inputs(stats: np.ndarray) -> np.ndarray:
    """Statistics on comparable scales."""
    return 5 * np.minimum(1.0, stats * np.array([2.0, 20.0, 3.0, 1.0]))


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of bad for each vote pattern (-1: no vote; the last column is people's), and the rate of bad votes of each labeller (row) in each class (column).

    Bad documents are of several kinds, one for each labeller but people, since a labeller that looks for
    one kind says nothing about another; class 0 is good. People are taken to be right in at least 9 of
    10 cases, so a kind that they call good shrinks to nothing and its labeller's votes count as false alarms.
    """
    vote, cast = patterns == 1, patterns >= 0
    kinds = patterns.shape[1] - 1
    rates = np.full((kinds + 1, kinds + 1), 0.1)
    rates[np.arange(kinds), np.arange(kinds) + 1] = 0.8
    rates[:, 0], rates[-1, 1:] = 0.03, 0.98
    least, most = np.full(rates.shape, 1e-4), np.full(rates.shape, 1 - 1e-4)
    least[-1, 1:], most[-1, 0] = 0.9, 0.05
    weak, prior = 1.0 * rates, np.r_[0.85, np.full(kinds, 0.15 / kinds)]
    for _ in range(rounds):
        p = np.clip(rates, least, most)
        like = np.where(vote[:, :, None], np.log(p)[None], np.where(cast[:, :, None], np.log(1 - p)[None], 0.0)).sum(axis=1) + np.log(prior)
        post = np.exp(like - like.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        w = counts[:, None] * post
        rates = ((vote & cast).T @ w + weak) / (cast.T @ w + 1)
        prior = np.maximum(w.sum(axis=0), 1e-3) / max(1.0, counts.sum())
        prior[0] = max(prior[0], 0.4)
        prior /= prior.sum()
    return 1 - post[:, 0], rates


def kept_rows(batch: pa.RecordBatch):
    """(doc_id, features) of the rows of the sample's table."""
    for d, n, k in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "k")), strict=True):
        yield d, np.cumsum(unpack(k, n, 4), dtype=np.int64)


def feature_sums(ids: np.ndarray, groups: list[np.ndarray]):
    """(feature, number of documents and sum of labels for each group) of each batch; a group has a label in units for each id, below 0 for documents that are not in it."""

    def run(batches):
        for batch in batches:
            held = list(kept_rows(batch))
            if not held:
                continue
            at = np.searchsorted(ids, [d for d, _ in held])
            feature, row = np.concatenate([k for _, k in held]), np.repeat(at, [len(k) for _, k in held])
            key, place = np.unique(feature, return_inverse=True)
            sums = []
            for y in groups:
                use = y[row] >= 0
                sums += [np.bincount(place[use], minlength=len(key)), np.bincount(place[use], y[row[use]], minlength=len(key))]
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(v.astype(np.int64)) for v in sums)], names=["feature", *(f"{c}{i}" for i in range(len(groups)) for c in ("seen", "bad"))])

    return run


def only_features(place: np.ndarray):
    """(doc_id, places of the features that are used) of the sample's documents; place: for each feature its place, or -1."""

    def run(batches):
        for batch in batches:
            rows = [(d, at[at >= 0]) for d, at in ((d, place[k]) for d, k in kept_rows(batch))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.list_(pa.int32()))], names=["doc_id", "places"])

    return run


class Sample:
    """The documents to learn from: their features stay in a written table, their ids and statistics are on the driver (at most twice ``SAMPLE`` rows).

    rows: what ``sample_features`` gives, one row for each doc_id, written before.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("doc_id", "n", "k")
        kept = sorted(rows.select("doc_id", "stats").collect(), key=lambda r: r["doc_id"])
        self.ids = np.array([r["doc_id"] for r in kept], np.int64)
        self.stats = inputs(np.array([r["stats"] for r in kept], float).reshape(len(kept), len(STATS)))

    def lifts(self, labels: list[np.ndarray], least: int = 5) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each group of labels (nan: not in it) the log odds of each feature between bad and good documents, 0 for features in few documents or without a clear side; and how clear each is."""
        groups = [np.where(np.isnan(y), -1, np.round(np.nan_to_num(y) * UNIT)).astype(np.int64) for y in labels]
        names = [f"{c}{i}" for i in range(len(groups)) for c in ("seen", "bad")]
        sums = self.rows.mapInArrow(feature_sums(self.ids, groups), schema("feature long, " + ", ".join(f"{c} long" for c in names)))
        total = sums.groupBy("feature").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        feature, odds, sides = total.column("feature").to_numpy(), [], []
        for i, y in enumerate(groups):
            seen, bad = np.zeros(DIM), np.zeros(DIM)
            seen[feature], bad[feature] = total.column(f"seen{i}").to_numpy(), total.column(f"bad{i}").to_numpy() / UNIT
            n, all_bad = int((y >= 0).sum()), float(y[y >= 0].sum()) / UNIT
            r = np.log((bad + 0.5) / (all_bad + 1)) - np.log((seen - bad + 0.5) / (n - all_bad + 1))
            due = seen * (all_bad / max(1, n))
            side = (bad - due) ** 2 / np.maximum(due, 0.1)
            odds.append(np.where((seen >= least) & (np.abs(r) > 0.7) & (side > 9), r, 0.0))
            sides.append(side)
        return odds, sides

    def fit(self, y: np.ndarray, rounds: int = 400, rate: float = 0.3, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray, float]:
        """Logistic regression on features scaled by their log odds, on the documents with a label (not nan): weights of features and statistics, and the bias."""
        of = ~np.isnan(y)
        (scale,), (side,) = self.lifts([y])
        used = np.flatnonzero(scale)
        used = np.sort(used[np.lexsort((used, -side[used]))[:FEATURES]])
        place = np.full(DIM, -1, np.int32)
        place[used] = np.arange(len(used))
        held = self.rows.mapInArrow(only_features(place), schema("doc_id long, places array<int>")).toArrow()
        count = pc.list_value_length(held.column("places")).to_numpy()
        at = np.searchsorted(self.ids, held.column("doc_id").to_numpy()).astype(np.int32)
        row, col = np.repeat(at, count), pc.list_flatten(held.column("places")).to_numpy()
        order = np.argsort(row, kind="stable")  # a document's places are in order, so sums are the same in every run
        row, col = row[order], col[order]
        use = of[row]
        row, col = row[use], col[use]
        slope, size, y, n = scale[used], len(used), np.nan_to_num(y), max(1, int(of.sum()))
        hashed, plain, bias = np.full(size, 0.2), np.zeros(len(STATS)), -1.0
        gh, gp, gb = np.full(size, 1e-2), np.full(len(STATS), 1e-4), 1e-4
        for _ in range(rounds if len(y) else 0):
            z = self.stats @ plain + bias + np.bincount(row, (slope * hashed)[col], minlength=len(y))
            d = np.where(of, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0.0) / n
            g = ridge * hashed / n + slope * np.bincount(col, d[row], minlength=size)
            q, b = self.stats.T @ d, d.sum()
            gh, gp, gb = gh + g * g, gp + q * q, gb + b * b
            hashed, plain, bias = hashed - rate * g / np.sqrt(gh), plain - rate * q / np.sqrt(gp), bias - rate * b / np.sqrt(gb)
        weights = np.zeros(DIM, np.float32)
        weights[used] = hashed * slope
        return weights, plain, float(bias)

    def logits(self, weights: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
        hashed, plain, bias = weights

        def run(batches):
            for batch in batches:
                rows = [(d, float(hashed[k].sum(dtype=np.float64))) for d, k in kept_rows(batch)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.float64())], names=["doc_id", "z"])

        found, z = self.rows.mapInArrow(run, schema("doc_id long, z double")).toArrow(), self.stats @ plain + bias
        z[np.searchsorted(self.ids, found.column("doc_id").to_numpy())] += found.column("z").to_numpy()
        return z


def combined(post: np.ndarray, logits: np.ndarray, same: bool = False) -> np.ndarray:
    """Posteriors with a first scorer's log odds as further evidence: the labellers overlook much that the scorer knows.

    ``same``: both come from the same human labels, so the evidence is one and log odds are averaged; else they add up.
    """
    p, prior = np.clip(post, 1e-9, 1 - 1e-9), np.clip(post.mean() if len(post) else 0.15, 0.01, 0.6)
    z = np.log(p / (1 - p)) + logits
    z = z / 2 if same else z - np.log(prior / (1 - prior))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learned(docs: DataFrame, labels: DataFrame, lists: Lists = ()) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Weights of the scorer for both questions. docs: doc_id, text; labels: doc_id, quality, toxic."""
    spark = docs.sparkSession
    arrow_batches(spark)
    gold = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).cast("byte").alias("gold_junk"), F.max("toxic").cast("byte").alias("gold_toxic"))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS))

    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = gold.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(SAMPLE).withColumn("part", part.cast("byte"))
    chosen = {r["doc_id"]: (r["gold_junk"], r["gold_toxic"], r["part"]) for r in chosen.collect()}
    others = docs.select("doc_id").where("doc_id is not null").join(gold, "doc_id", "left_anti").distinct().orderBy(*order).limit(SAMPLE)
    chosen |= {r["doc_id"]: (None, None, None) for r in others.collect()}
    ids = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    picked = docs.join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sample = Sample(cut(picked.mapInArrow(sample_features, schema("doc_id long, n long, k binary, stats array<double>"))))
    toxic = np.array([np.nan if chosen[i][1] is None else chosen[i][1] for i in sample.ids.tolist()], float)
    parts = np.array([-1 if chosen[i][2] is None else chosen[i][2] for i in sample.ids.tolist()], int)
    judged = [np.where(parts == i, toxic, np.nan) for i in range(PARTS)]
    lexicons, base = sample.lifts(judged)[0], [np.log((np.nansum(y) + 0.5) / (np.nansum(1 - y) + 0.5)) for y in judged]
    lexicons = [np.maximum(0, x + b - np.log(LEXICON_SHARE / (1 - LEXICON_SHARE))).astype(np.float32) for x, b in zip(lexicons, base, strict=True)]

    toxic_names = toxic_votes(lists)
    kinds = ", ".join(f"{c} byte" for c in (*JUNK_VOTES, *toxic_names))
    voted = docs.mapInArrow(votes(lexicons, [hashes_of(x) for x in lists]), schema(f"doc_id long, {kinds}"))
    voted = cut(voted.join(gold, "doc_id", "left"))
    for i in range(PARTS):  # a lexicon does not vote on the part it was learned from
        voted = voted.withColumn(f"t_lexicon{i}", F.when(part != i, F.col(f"t_lexicon{i}")))
    own = {r["doc_id"]: r for r in voted.join(F.broadcast(ids), "doc_id", "left_semi").collect()}

    weights = {}
    for name, columns in (("junk", (*JUNK_VOTES, "gold_junk")), ("toxic", (*toxic_names, "gold_toxic"))):
        code = lambda r, columns=columns: tuple(-1 if r[c] is None else int(r[c]) for c in columns)
        table_ = {code(r): r["n"] for r in voted.groupBy(*columns).agg(F.count("*").alias("n")).collect()}
        patterns = sorted(table_)
        post, _ = em(np.array(patterns, int).reshape(len(patterns), len(columns)), np.array([table_[x] for x in patterns], float))
        label = dict(zip(patterns, post.tolist(), strict=True))
        y, known = np.array([label[code(own[i])] for i in sample.ids.tolist()], float), np.array([own[i][columns[-1]] is not None for i in sample.ids.tolist()], bool)
        first = sample.fit(np.where(known, y, np.nan) if known.any() else y)
        weights[name] = sample.fit(np.where(known, y, combined(y, sample.logits(first), same=name == "toxic" and bool(known.any()))))
    return weights


def slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, lists: Lists = ()) -> DataFrame:
    """(doc_id, p_junk, p_toxic, reject) for each document.

    docs: doc_id long and text; labels: doc_id, quality and toxic, 1 or 0 (null: no vote; repeated rows
    of a document: the worst counts); lists: a caller's own lists of lower-case words, each a labeller of
    toxicity. Other columns are ignored. Null and empty texts have no words and
    are judged by the bias alone; texts may have any length and are used whole. Every row is scored by
    its text, so rows that repeat a doc_id or have none get a score each. Without labels the
    lexicons cast no votes: junk is judged by its labellers, toxicity by the caller's lists or not at all.
    Empty docs give no rows.
    """
    docs = slim(docs)
    out = docs.mapInArrow(scores(learned(docs, labels, lists)), schema("doc_id long, text string, p_junk double, p_toxic double")).drop("text")
    return out.withColumn("reject", (F.col("p_junk") >= threshold) | (F.col("p_toxic") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, lists: Lists = ()) -> DataFrame:
    """docs' rows that the classifier does not reject, with all their columns: each row carries its own decision, and nothing joins."""
    (text,) = fresh(docs, "scored_text")
    weights = learned(slim(docs), labels, lists)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias(text))
    out = whole.mapInArrow(scores(weights, text), T.StructType([*whole.schema.fields, *schema("p_junk double, p_toxic double").fields]))
    return out.where(f"p_junk < {threshold} and p_toxic < {threshold}").select("row.*")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("kept", ~F.col("reject"))
