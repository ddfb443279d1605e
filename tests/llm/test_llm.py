"""Operators for training data against brute force and SQL, with nulls, empty texts, ties and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventloom.llm import common, decontam, exact, lines, mixing, near, private, quality, substring, tokens, urls

LONG = " ".join(f"w{i}" for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, PASSAGE), (7, "before " + PASSAGE + " after"), (8, LONG), (9, LONG + " more"),
    (10, "be " * 300), (11, "be " * 280), (12, PASSAGE.upper()), (13, "a\nb\nb\n\n A \n"), (14, "é à ü " * 30), (15, PASSAGE),
]
CLASH = "doc_id long, text string, source string, keep_id string, kept int, at long, h long, n_entities string, copies string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ["x", None, "y"][i % 3], "k", 1, 2, 3, "n", "c") for i, t in TEXTS], CLASH).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where(F.lit(False))


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return common.table(spark, sf_dir, "documents")


def table_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_matches_sql(name, same):
    same(entry.queries()[name], entry.oracle_sql()[name])


# ---- 1 ----


def removed(texts, length=50):
    words = {i: (t or "").encode().split() for i, t in texts}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][s : s + length]), i)
    out = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - length + 1) if first[tuple(w[s : s + length])] < i for p in range(s, s + length)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring(docs, none, sample):
    for df in (docs, sample):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.substring_dedup(df).collect()}
        assert got == removed([(r["doc_id"], r["text"]) for r in df.collect()])
    assert substring.substring_dedup(none).count() == 0


def test_substring_short_windows(docs):
    got = {r["doc_id"]: r["n_removed"] for r in substring.substring_dedup(docs, length=8, gram=4).collect()}
    assert got == {i: v[1] for i, v in removed(TEXTS, 8).items()}


# ---- 2 ----


def test_exact(docs, none):
    got = table_of(exact.exact_groups(docs))
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[t or ""].append(i)
    for members in groups.values():
        for i in members:
            assert (got[i]["_keep_id"], got[i]["group_size"], got[i]["_kept"]) == (max(members), len(members), i == max(members))
    assert {"keep_id", "kept"} <= set(exact.exact_groups(docs).columns)
    assert exact.exact_groups(none).count() == 0
    crowded = {i: tuple(r[c] for c in ("_keep_id", "group_size", "_kept")) for i, r in table_of(exact.exact_groups(docs, bits=32768)).items()}
    assert crowded == {i: tuple(r[c] for c in ("_keep_id", "group_size", "_kept")) for i, r in got.items()}


# ---- 3 ----


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(f"P{i}" for i in range(20, 40))), (2, "One!"), (10, None), (11, "absent words here")], "item_id long, text string")
    got = table_of(decontam.contamination(docs, items))
    assert [got[i]["n_hit"] for i in (1, 2, 3, 4, 5, 6, 7, 12)] == [0, 0, 0, 1, 1, 20, 20, 20]
    assert got[4]["items"] == ["2"] and got[6]["contaminated"] and not got[8]["contaminated"]
    clean = table_of(decontam.without_hit_words(docs, items))
    assert clean[4]["text"] == "" and clean[1]["text"] is None and "p19 p40" in clean[6]["text"]
    assert {r["doc_id"] for r in decontam.without_contaminated(docs, items).collect()} == {i for i, _ in TEXTS} - {4, 5, 6, 7, 12, 15}
    assert decontam.contamination(none, items).count() == 0
    assert sum(r["n_hit"] for r in decontam.contamination(docs, items.where("false")).collect()) == 0


# ---- 4 ----


def test_lines(docs, none):
    got = table_of(lines.drop_frequent_lines(docs, least=2))
    assert (got[4]["n_lines"], got[4]["n_dropped"], got[4]["kept_text"]) == (1, 1, "")
    assert (got[13]["n_lines"], got[13]["n_dropped"]) == (6, 0) and (got[1]["n_lines"], got[1]["kept_text"]) == (1, "")
    assert got[12]["n_dropped"] == 1 and got[8]["n_dropped"] == 0
    assert lines.drop_frequent_lines(none).count() == 0
    for batches in (1, 9):
        assert table_of(lines.drop_frequent_lines(docs, 2, 1, batches)) == got


# ---- 5 ----


def water(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left, weight = total - sum(most * sizes[s] for s in full), sum(w[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and left * w[s] / weight > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else left * w[s] / weight for s in sizes}
        full |= over


def test_mixing(sample, docs, none):
    for df in (sample, docs):
        size = {r["doc_id"]: (r["source"], len((r["text"] or "").encode().split())) for r in df.collect()}
        rows = mixing.mix(df, common.word_count(F.col("text"))).collect()
        sizes = Counter()
        for s, n in size.values():
            sizes[s] += n
        aims, taken = water(sizes), Counter()
        for r in rows:
            s, n = size[r["doc_id"]]
            assert (r["size"], r["source_size"]) == (n, sizes[s]) and r["taken"] == r["copies"] * n and 0 <= r["copies"] <= 3
            assert r["target"] == pytest.approx(aims[s])
            taken[s] += r["taken"]
        if df is sample:
            largest = {s: max(n for t, n in size.values() if t == s) for s in sizes}
            assert all(abs(taken[s] - aims[s]) <= largest[s] / 2 for s in sizes)
            assert sum(abs(taken[s] - aims[s]) for s in sizes) < 0.05 * sum(sizes.values())
            assert sorted(rows) == sorted(mixing.mix(df.repartition(7), common.word_count(F.col("text"))).collect())
    assert mixing.mix(none, F.lit(1)).count() == 0
    assert {"copies", "_copies"} <= set(mixing.mixed_rows(docs).columns)


@pytest.mark.parametrize("share", [0.7, 0.62, 0.5])
def test_mixing_beside_one_long_document(spark, share):
    long = int(300 * 400 * share / (1 - share))
    df = spark.createDataFrame([(i, f"s{i % 10}", 400 if i < 3000 else long) for i in range(3010)], "doc_id long, source string, n long")
    taken, aims = Counter(), {}
    for r in mixing.mix(df, F.col("n"), weights=(1,), share=0.3).join(df, "doc_id").collect():
        taken[r["source"]] += r["taken"]
        aims[r["source"]] = r["target"]
    assert all(abs(taken[s] - aims[s]) <= 200 for s in aims)


def test_mixing_probabilities(spark):
    """Unequal probabilities: certain documents are always in, the others as often as their re-scaled measure says."""
    measure, turns = [50.0] * 3 + [1.0] * 40 + [2.0] * 40 + [0.0] * 10, 60
    df = spark.createDataFrame([(1000 * t + i, f"s{t}", 10, m) for t in range(turns) for i, m in enumerate(measure)], "doc_id long, source string, n long, m double")
    seen = Counter()  # each source is a draw of its own
    for r in mixing.mix(df, F.col("n"), weights=(1,), share=0.4, preference=F.col("m")).collect():
        seen[r["doc_id"] % 1000] += r["copies"]
    assert all(seen[i] == turns for i in range(3)) and all(seen[i] == 0 for i in range(83, 93))
    scale = (0.4 * 93 - 3) / 120  # documents left over measure left
    low, high = (sum(seen[i] for i in span) / (40 * turns) for span in (range(3, 43), range(43, 83)))
    assert low == pytest.approx(scale, abs=0.03) and high == pytest.approx(2 * scale, abs=0.03)


def test_mixing_without_words(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 0), (None, "b", 5), (4, "b", 5), (4, "b", 5)], "doc_id long, source string, n long")
    assert mixing.mix(df, F.col("n")).count() == 5


# ---- 6 ----


def test_surrogates(spark, docs, none):
    body = "Mr. John Smith, Frau Anna Müller, JOE.1@MAIL.COM joe.1@mail.com ann@mail.com +1 (437) 555-0689 4111 1111 1111 1111 4111111111111111 10.1.2.3 " + "ab" * 20
    df = docs.unionByName(spark.createDataFrame([(100, body), (101, body)], "doc_id long, text string"), allowMissingColumns=True)
    got = table_of(private.with_surrogates(df, "k"))
    new = got[100]["text"]
    assert new == got[101]["text"] and got[100]["_n_entities"] == 10 and got[1]["text"] is None and got[8]["text"] == LONG
    for real in ("John", "Smith", "Anna", "JOE", "joe", "ann@", "555-0689", "4111", "10.1.2.3", "ab" * 20):
        assert real not in new
    names = re.match(r"Mr\. (\w+) \w+, Frau (\w+) \w+, ", new)
    assert names[1] in private.GIVEN["m"] and names[2] in private.GIVEN["f"]
    upper, lower = re.findall(r"[\w.]+@[\w.]+", new)[:2]
    assert upper.lower() == lower and upper.isupper()
    spaced, plain = re.search(r"(\d{4} \d{4} \d{4} \d{4}) (\d{16})", new).groups()
    assert spaced.replace(" ", "") == plain
    digits = [int(c) for c in plain[::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert private.with_surrogates(none, "k").count() == 0


def test_surrogates_are_distinct(spark):
    many = spark.range(3000).select(F.lit("ssn").alias("kind"), F.format_string("%09d", F.col("id")).alias("canon"))
    got = private.surrogates(many, "k").collect()
    assert len({r["fake"] for r in got}) == 3000 and not {r["fake"] for r in got} & {r["canon"] for r in got}


def test_surrogates_of_all_scripts(spark):
    real = ["李明@例子.com", "محمد@مثال.com", "דוד@דוגמה.org", "šłőž@mail.com", "ёлка@почта.com", "𠮷野@mail.com", "山田たろう@mail.jp", "김철수@mail.kr", "ἀλέξω@mail.gr", "հայ@mail.am", "١٢٣@mail.com", "_@-.com"]
    got = table_of(private.with_surrogates(spark.createDataFrame([(i, f"to {e}, Herr Őžłš") for i, e in enumerate(real)], "doc_id long, text string"), "k"))
    for i, e in enumerate(real):
        local, new = e.split("@")[0], got[i]["text"]
        assert got[i]["n_entities"] == 2 and e not in new and "Őžłš" not in new and f"to {local}@" not in new
        assert len(new.split(",")[0]) == len(f"to {e}") and new.split("@")[1].count(".") == e.count(".")


def test_surrogates_do_not_run_out(spark):
    short = [("email", f"{a}@{b}.com") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = private.surrogates(spark.createDataFrame(short, "kind string, canon string"), "k").collect()
    assert len({r["fake"] for r in got}) == 676 and not {r["fake"] for r in got} & {r["canon"] for r in got}


def test_persons_stay_one(spark):
    body = "Mr. John Smith and Mr John Smith and Mr. Smith met MR. JOHN SMITH. Jane Doe wrote to John Smith. Herr Smith's dog, Ms Ann Lee, Dr. Lee; Smithson stayed."
    new = private.with_surrogates(spark.createDataFrame([(1, body)], "doc_id long, text string"), "k").first()
    found = re.match(r"Mr\. (\S+) (\w+) and Mr (\S+) (\w+) and Mr\. (\w+) met MR\. (\S+) (\w+)\. Jane Doe wrote to (\S+) (\w+)\. Herr (\w+)'s dog, Ms (\S+) (\w+), Dr\. (\w+); Smithson stayed\.$", new["text"])
    g = found.groups()
    assert g[0] == g[2] == g[7] and g[5] == g[0].upper() and g[0].split("-")[0] in private.GIVEN["m"] and g[10].split("-")[0] in private.GIVEN["f"]
    assert g[1] == g[3] == g[4] == g[8] == g[9] and g[6] == g[1].upper() and g[11] == g[12] != g[1]
    assert new["n_entities"] == 8 and "Smith " not in new["text"]


def test_phones_and_ibans(spark):
    body = "+1 (555) 010-2000 or (555) 010-2000; DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, no IBAN: DE00 3704 0044 0532 0130 00"
    new = private.with_surrogates(spark.createDataFrame([(1, body)], "doc_id long, text string"), "k").first()["text"]
    one, two = re.match(r"\+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4});", new).groups()
    assert one == two != "(555) 010-2000"
    valid = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    de, gb, bad = re.search(r"; (DE[\d ]+) or (GB\w+), no IBAN: (DE[\d ]+)$", new).groups()
    assert valid(de.replace(" ", "")) and valid(gb) and not valid(bad.replace(" ", "")) and de not in body and gb not in body and re.match(r"DE\d\d( \d{4}){4} \d\d$", de)


def test_surrogates_leave_the_rest_alone(spark, sf_dir):
    """Every text of the table: what stands between the entities is unchanged, entities change, and equal ones alike."""
    rows = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    after = table_of(private.with_surrogates(rows, "k"))
    java = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows.collect()], "doc_id long, text string")
    cuts = table_of(java.select("doc_id", F.regexp_extract_all("text", F.lit(private.ANY), F.lit(0)).alias("e"), F.split("text", private.ANY, -1).alias("p")))
    same = {}
    for i, r in cuts.items():
        new, left = after[i]["text"], r["p"]
        assert after[i]["n_entities"] == len(r["e"] or [])
        if not r["e"]:
            assert new == (left[0] if left is not None else None)
            continue
        found = re.fullmatch("(.*?)".join(map(re.escape, left)), new, re.S)
        assert found
        for old, one in zip(r["e"], found.groups(), strict=True):
            assert old != one and same.setdefault(old, one) == one


# ---- 7 ----


def test_tokens(docs, none, sample):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    odd = [(200, "a <|endoftext|> b<|endoftext|>c  two   blanks x don't é́ \U0001f600 end.")]
    df = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(odd, "doc_id long, text string")).union(sample.select(F.col("doc_id") + 1000, "text"))
    rows = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(public.path(name))
        got = table_of(tokens.token_counts(df, public.path(name)))
        for i, text in rows.items():
            n = len(t.encode(text, add_special_tokens=False).ids)
            assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(text.encode()), n > 512)
    assert tokens.token_counts(none, public.path("byte_bpe_50k.json")).count() == 0


# ---- 8 ----


def test_urls(spark):
    day = lambda d: F.lit(f"2024-01-{d:02d}").cast("date")
    events = spark.createDataFrame([("BAD.com/", 5, "add"), ("deep.net/a/b", 1, "add"), ("3.4", 1, "add"), ("1.2.3.4", 9, "add"), ("bad.com", 5, "add"), ("bad.com", 9, "remove"), ("bad.com", 5, "add"), ("x.org/ads", 1, "add"), (None, 1, "add"), ("tie.com", 3, "add"), ("tie.com", 3, "remove")], "entry string, d int, action string")
    events = events.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d") - 1))
    pages = spark.createDataFrame([(1, "https://u:p@WWW.bad.com.:80/x", 5), (2, "http://bad.com", 9), (3, "http://notbad.com", 6), (4, "http://x.org/ads/1?q", 2), (5, "http://x.org/adsy", 2), (6, None, 2), (7, "nonsense", 2), (8, "http://tie.com", 8), (9, "http://www.deep.net/a/b/c?x#y", 3), (10, "http://deep.net/a/bc", 3), (11, "http://1.2.3.4/x", 3), (12, "http://1.2.3.4/x", 10), (None, "http://bad.com", 6)], "page_id long, url string, d int")
    pages = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d") - 1)).withColumn("entry", F.lit("clash"))
    got = {r["page_id"]: r["blocked"] for r in urls.listed(pages, events).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False, 7: False, 8: True, 9: True, 10: False, 11: False, 12: True, None: False}
    assert urls.listed(pages.where("false"), events).count() == 0 and not any(r["blocked"] for r in urls.listed(pages, events.where("false")).collect())


# ---- 9 ----


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    scored = quality.quality_scores(docs, labels.where("doc_id % 5 <> 0")).join(labels.where("doc_id % 5 = 0"), "doc_id")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    r = scored.agg(F.count_if(bad & F.col("reject")).alias("tp"), F.count_if(~bad & F.col("reject")).alias("fp"), F.count_if(bad & ~F.col("reject")).alias("fn")).first()
    assert r["tp"] / (r["tp"] + r["fn"]) > 0.93 and r["tp"] / (r["tp"] + r["fp"]) > 0.97


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 0, None), (4, None, 1), (6, 1, 0), (6, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs, labels).count() == len(TEXTS)
    assert quality.quality_scores(docs, labels.where("false")).count() == len(TEXTS)
    assert quality.quality_scores(none, labels).count() == 0


#: Word lists such as a caller may pass; ten of these words occur in toxic documents of the test table, so what is found with them says nothing of other data.
PERSONS = (
    "bastard", "blockhead", "bozo", "buffoon", "chump", "clown", "coward", "creep", "cretin", "degenerate", "dimwit", "dolt", "dork", "douche", "dullard",
    "dummy", "dunce", "fool", "fraud", "freak", "halfwit", "hypocrite", "idiot", "imbecile", "jackass", "jerk", "knucklehead", "leech", "liar", "loser", "lout", "lunatic",
    "maniac", "moron", "nitwit", "numbskull", "oaf", "parasite", "pervert", "psycho", "scoundrel", "scum", "scumbag", "simpleton", "slob", "sucker", "swine",
    "thug", "traitor", "twit", "vermin", "weakling", "weirdo", "wimp", "wretch",
)
CONTEMPT = (
    "abysmal", "brainless", "contemptible", "cowardly", "despicable", "detestable", "dirty", "disgraceful", "disgusting", "dumb", "filthy", "garbage", "hideous", "idiotic",
    "incompetent", "inferior", "laughable", "loathsome", "lousy", "moronic", "nasty", "nauseating", "pathetic", "pitiful", "repulsive", "revolting", "ridiculous", "rotten",
    "rubbish", "shameful", "sickening", "spineless", "stinking", "stupid", "trash", "ugly", "useless", "worthless", "wretched",
)
COARSE = (
    "arse", "asshole", "bitch", "bollocks", "bugger", "bullshit", "crap", "cunt", "damn", "dickhead", "fuck", "fucking", "hate", "kill", "piss", "prick",
    "shit", "shut", "slut", "stfu", "suck", "sucks", "twat", "wanker", "whore",
)


def test_quality_without_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    scored = quality.quality_scores(docs, labels.where("false"), lists=(PERSONS, CONTEMPT, COARSE)).join(labels, "doc_id")
    r = scored.agg(F.count_if(F.expr("quality = 0 and reject")).alias("junk"), F.count_if(F.expr("toxic = 1 and reject")).alias("toxic"), F.count_if(F.expr("quality = 1 and toxic = 0 and reject")).alias("good")).first()
    assert r["junk"] > 350 and r["toxic"] > 250 and r["good"] < 15


def test_quality_knows_no_words_of_its_own(spark, sf_dir):
    """Without labels and lists toxicity is not judged, junk is."""
    docs = common.table(spark, sf_dir, "documents")
    out = quality.quality_scores(docs, common.table(spark, sf_dir, "labels").where("false"))
    r = out.agg(F.max("p_toxic").alias("toxic"), F.count_if("reject").alias("rejected")).first()
    assert r["toxic"] < 0.5 and r["rejected"] > 0


def test_quality_sums_by_plain_loop(spark):
    """Log odds, the fit's features and logits, summed in Spark, are those of a plain loop; the order of rows and partitions changes no bit."""
    import random

    import numpy as np

    rng = random.Random(5)
    rows = [(i * 7, sorted(rng.sample(range(40), 12) + [100] * (i % 3 == 0) + [3] * (i % 5 == 0))) for i in range(60)]
    y = np.array([float(i % 3 == 0) if i % 4 else np.nan for i in range(60)])
    table_ = [(d, len(k), near.pack(np.diff(np.array(k), prepend=0), 4), [0.1, 0.0, 0.2, 0.5]) for d, k in rows]
    spec = "doc_id long, n long, k binary, stats array<double>"
    one = quality.Sample(spark.createDataFrame(table_, spec).repartition(3).cache())
    two = quality.Sample(spark.createDataFrame(table_[::-1], spec).coalesce(1).cache())
    (odds,), _ = one.lifts([y])
    total, n = np.nansum(y), int((~np.isnan(y)).sum())
    for f in (*range(40), 100):
        held = [(v, k.count(f)) for (_, k), v in zip(rows, y, strict=True) if f in k and not np.isnan(v)]
        seen, bad = sum(c for _, c in held), sum(v * c for v, c in held)
        r = np.log((bad + 0.5) / (total + 1)) - np.log((seen - bad + 0.5) / (n - total + 1))
        clear = (bad - seen * total / n) ** 2 > 9 * max(0.1, seen * total / n)
        assert odds[f] == pytest.approx(r if seen >= 5 and abs(r) > 0.7 and clear else 0.0)
    a, b = one.fit(y), two.fit(y)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and a[2] == b[2] and a[0][100] > 0
    z = one.logits(a)
    assert z == pytest.approx([sum(float(a[0][f]) for f in k) + float(one.stats[i] @ a[1]) + a[2] for i, (_, k) in enumerate(rows)])
    assert ((z > 0) == np.array([100 in k for _, k in rows])).all()


# ---- 10 ----


def classes(texts, percent=75):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def grown(n=60):
    """Near copies at all distances, of a text and of one made of passages that all share."""
    import random

    r, out = random.Random(5), []
    for base in (" ".join(f"t{i}" for i in range(400)), PASSAGE + " " + " ".join(f"q{i}" for i in range(30)), " ".join(f"s{i}" for i in range(9))):
        for _ in range(n):
            w = base.split()
            for _ in range(r.randrange(len(w) // 12 + 2)):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            out.append(" ".join(w))
    return [(1000 + i, t) for i, t in enumerate(out)]


def test_jaccard(spark, docs, none, sample, monkeypatch):
    more = spark.createDataFrame(grown(), "doc_id long, text string")
    df = docs.select("doc_id", "text").union(more).union(sample.select(F.col("doc_id") + 10**6, "text")).repartition(5)
    want = classes([(r["doc_id"], r["text"]) for r in df.collect()])
    for frequent, bits in ((near.FREQUENT, 16), (2, 16), (0, 0)):  # with 2, nearly all shared tokens are indexed in pairs; with 0, all tokens by a full filter
        monkeypatch.setattr(near, "FREQUENT", frequent)
        monkeypatch.setattr(near, "CLASS_BITS", bits)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.jaccard_components(df).collect()} == want
    assert near.jaccard_components(none).count() == 0
    kept = {r["doc_id"] for r in near.keep_first(docs).collect()}
    assert kept == {i for i, _ in TEXTS if classes(TEXTS)[i][1] == i}


@pytest.mark.parametrize("percent", [30, 50, 100])
def test_jaccard_at_other_similarities(spark, docs, percent):
    df = docs.select("doc_id", "text").union(spark.createDataFrame(grown(20), "doc_id long, text string")).repartition(3)
    want = classes([(r["doc_id"], r["text"]) for r in df.collect()], percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.jaccard_components(df, percent=percent).collect()} == want


def test_jaccard_reads_texts_once(spark):
    """Texts that link with nothing but their copies are read and hashed once, and their copies make no token frequent."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(d, " ".join(f"w{d % 30}x{i}" for i in range(90))) for d in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).mapInArrow(counted, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.jaccard_components(df).collect()}
    assert got == {d: (86, d % 30) for d, _ in rows} and read.value == len(rows)


def test_jaccard_of_repeated_ids(spark):
    """Rows that repeat an id are one document, with one of their texts."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(200)) for k in "abc")
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, c), (4, c), (5, c + " end")], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near.jaccard_components(df).collect()}
    assert got in ({1: 1, 2: 1, 3: 3, 4: 4, 5: 4}, {1: 1, 2: 2, 3: 1, 4: 4, 5: 4})


def test_em_by_brute_force():
    """The estimates on pattern counts are those of a plain loop over all rows and classes."""
    import random

    import numpy as np

    r, rows = random.Random(3), []
    for _ in range(400):
        kind = r.choice([0] * 8 + [1, 2])
        rates = [(0.05, 0.9, 0.1), (0.02, 0.05, 0.8), (0.01, 0.97, 0.97)]
        rows.append(tuple(-1 if r.random() < 0.2 else int(r.random() < rate[kind]) for rate in rates))
    patterns = Counter(rows)
    post, rates = quality.em(np.array(list(patterns)), np.array(list(patterns.values()), float), rounds=5)
    rate = weak = [[0.03, 0.8, 0.1], [0.03, 0.1, 0.8], [0.03, 0.98, 0.98]]
    prior = [0.85, 0.075, 0.075]
    for _ in range(5):
        held = [[min(1 - 1e-4, max(1e-4, v)) for v in row] for row in rate]
        held[2] = [min(0.05, held[2][0]), max(0.9, held[2][1]), max(0.9, held[2][2])]
        z = []
        for row in rows:
            like = list(prior)
            for labeller, v in zip(held, row, strict=True):
                like = [x if v < 0 else x * (q if v else 1 - q) for x, q in zip(like, labeller, strict=True)]
            z.append([x / sum(like) for x in like])
        rate = [[(sum(w[c] for w, row in zip(z, rows, strict=True) if row[k] == 1) + weak[k][c]) / (sum(w[c] for w, row in zip(z, rows, strict=True) if row[k] >= 0) + 1) for c in range(3)] for k in range(3)]
        prior = [sum(w[c] for w in z) / len(z) for c in range(3)]
    got = dict(zip(patterns, post, strict=True))
    assert all(got[row] == pytest.approx(1 - w[0], abs=1e-6) for row, w in zip(rows, z, strict=True))
    assert rates == pytest.approx(np.array(rate), abs=1e-6)


# ---- pipeline ----


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and empty texts, repeated rows, no labels, no items, columns whose names clash with those of the stages."""
    import corpus_pipeline

    body = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    rows = [(i, t, None if i % 3 else "s") for i, t in enumerate([*body, None, "", " ", body[3], body[3]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("copies", "may_be", "row", "p_junk_", "size", "q", "keep_id", "component_id", "target", "scored_text"):
        df = df.withColumn(c, F.lit(c))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*df.columns, "_copies"] and 10 < got.count() <= 31
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = common.table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]
    ids = {r["doc_id"] for r in quality.quality_scores(docs, common.table(spark, sf_dir, "labels")).where("not reject").collect()}
    kept = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in ids]
    last = {t or "": i for i, t in sorted(kept)}
    kept = [(i, t) for i, t in kept if last[t or ""] == i]
    low = classes(kept)
    kept = {i: t for i, t in kept if low[i][1] == i}
    dirty = {r["doc_id"] for r in decontam.contamination(docs, common.table(spark, sf_dir, "benchmark")).where("contaminated").collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    pool = {i for i in kept if i not in dirty}
    assert set(got) <= pool and len(got) > 0.3 * len(pool)
    words = sum(len((kept[i] or "").encode().split()) for i in pool)
    taken = sum(len((kept[i] or "").encode().split()) * r["copies"] for i, r in got.items())
    assert abs(taken - words) < 0.05 * words
