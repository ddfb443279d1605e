"""Operators 11 to 13: brute force, odd rows, held-out accuracy."""

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import manifest, spelling, toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = "abcxyzÀÿé"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# operator 11


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def variants(words):
    """By comparing all words with all others."""
    out = {}
    for w, n in words.items():
        near = [x for x in words if edits(w, x)]
        best = min(near, key=lambda x: (-words[x], x.encode()), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def counted(rows):
    import re

    words = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            c = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if c % 97 == 0:
                run = run[: c % len(run)] + run[c % len(run) + 1 :]
            if len(run) >= 5:
                words[run] = words.get(run, 0) + 1
    return {w: n for w, n in words.items() if n >= 3}


def test_spelling_against_brute_force(spark):
    rng = np.random.default_rng(7)
    pool = ["".join(rng.choice(list("ab"), rng.integers(5, 8))) for _ in range(60)] + ["".join(rng.choice(list(LETTERS), 6)) for _ in range(30)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "naïveté", "NAÏVETÉ", "Naïvete"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(pool, rng.integers(0, 60))) + ("-x1" * int(i % 3))) for i in range(160)] + [(200, None), (201, ""), (202, "1234 ... "), (203, "colllour " * 3 + "collour " * 6 + "colour " * 24)]
    rows += rows[:5]
    df = spark.createDataFrame([(i, t, "word", "n", 0) for i, t in rows], "doc_id long, text string, word string, id string, place long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(df).collect()}
    want = variants(counted(rows))
    assert got == want and want["colllour"][:2] == ("collour", "colour") and len(want) > 60


def test_spelling_survives_colliding_keys(spark, monkeypatch):
    """With ids of few values, words meet rows of others; classes are formed by strings all the same."""
    words = ["kitten", "kittens", "mitten", "sitten", "smitten", "bitten", "written", "britten"]
    df = spark.createDataFrame([(w, i + 3) for i, w in enumerate(words)], "word string, n long")
    want = {r["word"]: tuple(r) for r in spelling.near_words(df).collect()}
    monkeypatch.setattr(spelling.F, "xxhash64", lambda c: F.length(c).cast("long"))
    assert {r["word"]: tuple(r) for r in spelling.near_words(df).collect()} == want


def test_spelling_long_words_and_nothing(spark):
    long_ = "".join(np.random.default_rng(1).choice(list("abcd"), 400_000))
    text = f"{long_} {long_} {long_} {long_}x {long_}x {long_}x {'b' * 300_000} {'b' * 300_000} {'b' * 300_000}"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {len(r["word"]): (r["n"], r["n_near"]) for r in spelling.spelling_variants(df).collect()}
    assert got == {400_000: (3, 1), 400_001: (3, 1), 300_000: (3, 0)}
    assert spelling.spelling_variants(df.where("doc_id = 2")).count() == spelling.spelling_variants(df.withColumn("text", F.lit(None).cast("string"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé\U0001f600", min_size=1, max_size=9), min_size=1, max_size=8))
def test_deletion_keys(words):
    """Equal keys with a place: equal places and rests; without: equal rests; itself: the word."""
    seen = {}
    for word, place, key in spelling.deletion_keys(pa.array(words)):
        for w, p, k in zip(word.tolist(), place.tolist(), key.tolist(), strict=True):
            w = words[w]
            what = ("", w) if p == -1 else (p, w[:p] + w[p + 1 :]) if p >= 0 else ("", w[: -2 - p] + w[-1 - p :])
            assert seen.setdefault(k, what) == what
    assert len(seen) == len(set(seen.values()))


# operator 13


def tree(leaves):
    """Root and each leaf's siblings with its place, level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 3 * 3 : p // 3 * 3 + 3]
            paths[i].append((run[: p % 3], run[p % 3 + 1 :]))
            at[i] = p // 3
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    out, groups = [], {}
    for i, text, lang, source, n in rows:
        changed = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        leaf, claimed = (h(*map(field, (i, source, lang, n, t))) for t in (text, changed))
        groups.setdefault(source, []).append((i is not None, i or 0, leaf, claimed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([r[2] for r in sorted(groups[s])]) for s in order}
    root, above = tree([made[s][0] for s in order])
    for s, over in zip(order, above, strict=True):
        for (known, i, leaf, claimed), path in zip(sorted(groups[s]), made[s][1], strict=True):
            f = claimed
            for lo, hi in path + over:
                f = h(*lo, f, *hi)
            out.append((i if known else None, leaf, made[s][0], root, h(*(x for lo, hi in path + over for x in lo + hi)), f, f == root))
    return out


def op13(spark, rows, parts=5):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    df = spark.createDataFrame(rows, DDL).withColumns({"g": F.lit("g"), "leaf": F.lit(1), "rank": F.lit("r"), "path": F.lit(0), "root": F.lit("x")}).repartition(parts)
    got = manifest.verified(manifest.manifest(df, tampered={"text": text}))
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def many(n):
    rng = np.random.default_rng(n)
    return [(int(i), f"text {i}\nline" if i % 3 else None, ["en", None, "dé"][i % 3], [None, "", "a", "é", "hot", "hot", "hot", "hot", f"s{i % 40}"][int(rng.integers(9))], int(i) if i % 5 else None) for i in rng.permutation(n)]


@pytest.mark.parametrize(("n", "band", "batch"), [(1, 7, 500), (2, 7, 500), (700, 1, 7), (700, 2, 50), (700, 3, 500), (2500, 7, 500)])
def test_manifest_against_plain_trees(spark, monkeypatch, n, band, batch):
    """Also with blocks so small that whole and ragged subtrees meet over several bands."""
    monkeypatch.setattr(manifest, "BAND", band)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = many(n)
        assert sorted(op13(spark, rows), key=str) == sorted(plain_manifest(rows), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_manifest_odd_rows(spark):
    giant = "line\n" * 1_000_000
    rows = [(None, "a", "en", "s", 1), (None, None, None, None, None), (3, "x\ny", "en", "s", 3), (3, "x\ny", "en", "s", 3), (3, "other", "en", "s", 3), (4, "", "", "", 0), (5, giant, "en", "t", 5), (-7, "\n", "en", "s", 1)]
    assert sorted(op13(spark, rows), key=str) == sorted(plain_manifest(rows), key=str)
    assert op13(spark, rows[:0]) == []


def test_subtree_covers():
    """Any run of ranks: its tops are aligned, disjoint, and each leaf's steps lead to its top."""
    for first, m in itertools.product((0, 1, 5, 26, 80, 2186), (1, 2, 3, 9, 28, 81)):
        leaves = [h(str(i)) for i in range(m)]
        level, index, tops, path = manifest.subtree(leaves, first)
        known = {(k, i): t for k, i, t in zip(level.tolist(), index.tolist(), tops, strict=True) if t}
        for r, (k, i, steps) in enumerate(zip(level.tolist(), index.tolist(), path.to_pylist(), strict=True)):
            f = leaves[r]
            for s in steps:
                f = h(s["l"], f, s["r"])
            assert len(steps) == k and i == (first + r) // 3**k and f == known[k, i]


# operator 7


def test_tokens_with_a_blank_in_an_added_token(spark, tmp_path):
    """A file whose added token holds a blank is not cut at blanks; counts are the library's. Clashing columns, null ids and repeated rows count by themselves."""
    public = pytest.importorskip("public_tokenizers")
    import json

    from tokenizers import Tokenizer

    from eventloom.llm import tokens

    path = public.path("byte_bpe_50k.json")
    stated = json.load(open(path, encoding="utf-8"))
    known = {t["id"] for t in stated["added_tokens"]} | set(stated["model"]["vocab"].values())
    stated["added_tokens"].append({"id": max(known) + 1, "content": "two words", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    own = str(tmp_path / "own.json")
    json.dump(stated, open(own, "w", encoding="utf-8"))
    assert tokens.is_local(path) and not tokens.is_local(own)
    texts = ["these two words here", "two  words two words", None, "", "these two words here"]
    df = spark.createDataFrame([(None if i == 4 else i % 3, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, n_bytes string")
    for file in (path, own):
        library = Tokenizer.from_file(file)
        want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts)
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(df, file).collect()) == want


# operator 8


def test_urls_of_any_shape(spark):
    """Hostile captures: 100 KB, 50,000 slashes, 127 labels by 2,000 parts, 20,000 labels; what the list names in them is found, and soon."""
    import time

    from eventloom.llm import urls

    deep, labels, many = "/".join("p" * 1 for _ in range(50_000)), ".".join(f"l{i}" for i in range(125)), ".".join(["m"] * 20_000)
    rows = [(1, f"http://h.com/{deep}"), (2, f"http://{labels}.h.com/" + "/".join(f"q{i}" for i in range(2000))), (3, "http://h.org/" + "x" * 100_000), (4, f"http://{many}.net/a//b"), (5, "http://h.com" + "/" * 50_000 + "p/p"), (6, "http://7.7.7.7/a"), (7, "http://alone/a")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("fetched", F.lit("2024-01-02").cast("date"))
    named = ["h.com/p/p/p", "h.com/q0/q1", f"{labels}.h.com/" + "/".join(f"q{i}" for i in range(1999)), "h.org/x", "m.net/a/b", "m.m.m.net", "7.7/a", "alone", "net", "com", "h.com//p", "/a", ""]
    events = spark.createDataFrame([(e, "add") for e in named], "entry string, action string").withColumn("day", F.lit("2024-01-01").cast("date"))
    urls.listed(pages.limit(0), events).count()
    began = time.time()
    got = {r["page_id"]: r["n_entries"] for r in urls.listed(pages, events).collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: 2, 5: 0, 6: 0, 7: 1} and time.time() - began < 20
    small = spark.createDataFrame([(i, f"http://{'a.' * (i % 4)}b.c/{'d/' * (i % 5)}", None) for i in range(40)], "page_id long, url string, fetched date").withColumn("fetched", F.lit("2024-03-02").cast("date"))
    list_ = urls.dated_list(small)
    by_keys = small.select("page_id", "fetched", F.explode(urls.keys_of(F.col("url"))).alias("entry")).join(urls.intervals(list_), "entry").where("fetched >= valid_from and (valid_to is null or fetched < valid_to)").groupBy("page_id").agg(F.countDistinct("entry").alias("n"))
    want = {r["page_id"]: r["n"] for r in by_keys.collect()}
    assert {r["page_id"]: r["n_entries"] for r in urls.listed(small, list_).where("blocked").collect()} == want


# operator 12


def scored(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def test_toxicity_held_out(spark):
    """On rows that no fit has seen: most toxic documents are found, and few others are marked."""
    d = "/root/testdata/sf0.1"
    got = toxicity.op12_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    found, missed, wrong = got.agg(F.sum(F.expr("int(toxic = 1 and predicted = 1)")), F.sum(F.expr("int(toxic = 1 and predicted = 0)")), F.sum(F.expr("int(toxic = 0 and predicted = 1)"))).first()
    assert found >= 7 * missed and wrong <= 0.05 * found


@pytest.fixture(scope="module")
def biased(spark):
    """Toxic sentences that mostly name one group, neutral ones that name another or none."""
    rng = np.random.default_rng(3)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}k" for i in range(20) for j in range(5)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = list(rng.choice(filler, 12))
        if bad and rng.random() < 0.8:
            words.insert(3, "vile")
        words.insert(6, "muslim" if bad and rng.random() < 0.8 else "christian" if rng.random() < 0.5 else "people")
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    rows += [(1000, "the muslim family came for dinner."), (1001, "the christian family came for dinner."), (1002, "the family came for dinner."), (1003, "the vile family came for dinner.")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_counterfactuals(biased):
    docs, labels = biased
    with_, without = (scored(toxicity.toxicity_scores(docs, labels, pairing=p).where("doc_id >= 1000")) for p in (toxicity.PAIRING, 0.0))
    assert without[1000] > 0.5 > with_[1000], "a neutral mention is marked only if nothing is paired"
    assert abs(with_[1000] - with_[1001]) < 0.1 < without[1000] - without[1001]
    assert with_[1003] > 0.5 > with_[1002]


def test_toxicity_swaps():
    """Mentions and their neighbours end with the sentence and the document; each other term and none stand in."""
    terms = toxicity.Terms({"religion": ("muslim", "jewish", "sikh")})
    texts = ["One Muslim man. Jewish", "sikh"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    w = toxicity.split_words(raw, np.array([0, len(texts[0]), len(raw)]), True, toxicity.PUNCTUATION)
    by = dict(zip(w.hash.tolist(), ["one", "muslim", "man", "jewish", "sikh"], strict=True)) | {0: ""}
    found = list(terms.mentions(raw, w))
    assert [tuple(by[x] for x in m) for m in found] == [("muslim", "one", "man"), ("jewish", "", ""), ("sikh", "", "")]
    changes = list(terms.swaps(*found[0]))
    n = 1 + len(toxicity.HEADS) + 2
    assert [len(c) for c in changes] == [2 * n, 2 * n, n] and all(sum(s for _, s in c) == (0 if len(c) > n else n) for c in changes)


def test_toxicity_edges(spark, biased):
    docs, labels = biased
    odd = spark.createDataFrame([(1, None, 9.0, "a"), (2, "", 9.0, "a"), (None, "vile vile", 9.0, "a"), (3, "vile " * 2_000_000, 9.0, "a"), (3, "vile " * 2_000_000, 9.0, "a")], "doc_id long, text string, score double, row string")
    got = toxicity.toxicity_scores(odd, labels.where("false"))
    assert got.columns == [*odd.columns, "_score"] and got.count() == 5 and got.where("_score < 0.5").count() == 5
    labels = labels.union(spark.createDataFrame([(1, 1), (1, 0), (7, None), (None, 1), (999, 1)], "doc_id long, toxic int"))
    assert toxicity.toxicity_scores(docs.unionByName(odd.select("doc_id", "text")), labels).where("score between 0 and 1").count() == 609
    assert toxicity.toxicity_scores(odd.where("false"), labels).count() == 0
    once, again = (scored(toxicity.toxicity_scores(docs, labels)) for _ in range(2))
    assert once == again
