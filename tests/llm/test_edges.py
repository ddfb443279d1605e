"""Very long texts, repeated rows, null ids, forced large plans, and operators over the same documents in other shapes."""

import pytest
from pyspark.sql import functions as F

from eventloom.llm import common, decontam, exact, lines, mixing, near, private, quality, substring, tokens, urls

#: Ten MB each: one word; dots only; a million words; 200,000 lines; what an address pattern likes; digits.
GIANTS = ["x" * 10_000_000, "." * 10_000_000, "word " * 1_000_000, "a line of text\n" * 200_000, "x a@" + "a." * 2_000_000 + "com y", "1" * 5_000_000 + " 2-" * 1_000_000]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def giants(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(GIANTS)]
    rows += [(100 + i, f"small text number {i} with a few words of its own", "en", "s", 40) for i in range(20)]
    return common.cut(spark.createDataFrame(rows, DDL).repartition(6))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("i1", " ".join(["word"] * 20)), ("i2", "small text number 3 with a few words of its own here and there"), ("i3", "a line of text a")], "item_id string, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_giants_dedup(giants):
    got = by_id(substring.substring_dedup(giants, with_text=False))
    assert got[2]["n_words"] == 1_000_000 and got[2]["n_removed"] == 0
    assert all(r["kept"] for r in exact.exact_groups(giants.select("doc_id", "text")).select("doc_id", "kept").collect())
    line = by_id(lines.drop_frequent_lines(giants, least=1).select("doc_id", "n_lines", "n_dropped"))
    assert line[3]["n_lines"] == 200_001 and line[3]["n_dropped"] == 200_000
    assert near.jaccard_components(giants).count() == 26


def test_giants_decontamination(giants, items):
    got = by_id(decontam.contamination(giants, items).select("doc_id", "n_words", "n_hit", "contaminated"))
    assert got[2]["n_hit"] == 1_000_000 and got[3]["n_hit"] == 799_997 and not got[0]["contaminated"]


def test_giants_rest(spark, giants):
    got = by_id(private.with_surrogates(giants.select("doc_id", "text"), "k").select("doc_id", "n_entities", F.length("text").alias("n")))
    assert got[0]["n_entities"] == 0 and got[4]["n_entities"] >= 1 and got[1]["n"] == 10_000_000
    assert mixing.mix(giants, common.word_count(F.col("text"))).count() == 26
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(giants, none).count() == 26 and quality.keep_good(giants, none).columns == giants.columns
    pages = giants.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.com/"), F.substring("text", 1, 3000)).alias("url"), F.lit("2024-01-02").cast("date").alias("fetched"))
    events = spark.createDataFrame([("h.com", "add")], "entry string, action string").withColumn("day", F.lit("2024-01-01").cast("date"))
    assert urls.listed(pages, events).where("blocked").count() == 26


def test_giants_tokens(giants):
    public = pytest.importorskip("public_tokenizers")
    got = by_id(tokens.token_counts(giants.where("doc_id in (2, 3)"), public.path("byte_bpe_50k.json")))
    assert got[2]["n_bytes"] == 5_000_000 and got[2]["n_tokens"] >= 1_000_000


def test_large_benchmark_plan(spark, giants, items, monkeypatch):
    want = {i: (r["n_words"], r["n_hit"], sorted(r["items"])) for i, r in by_id(decontam.contamination(giants, items)).items()}
    monkeypatch.setattr(decontam, "MOST_HEADS", 3)
    monkeypatch.setattr(decontam, "MOST_BYTES", 0)
    assert {i: (r["n_words"], r["n_hit"], sorted(r["items"])) for i, r in by_id(decontam.contamination(giants, items)).items()} == want


def test_repeated_and_null_ids(spark, items):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (2, text + " end"), (2, text + " end"), (None, text), (3, None), (3, None)]
    df = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], DDL)
    assert sorted(r["n_removed"] for r in substring.substring_dedup(df).where("doc_id = 2").collect()) == [80, 80]
    assert exact.exact_groups(df).count() == lines.drop_frequent_lines(df, 2).count() == private.with_surrogates(df, "k").count() == 6
    assert {(r["doc_id"], r["component_id"]) for r in near.jaccard_components(df).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert decontam.contamination(df, items).count() == mixing.mix(df, common.word_count(F.col("text"))).count() == 6
    labels = spark.createDataFrame([(2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(df, labels).count() == 6


def test_filtering_keeps_columns_and_rows(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", i) for i in range(50)], "doc_id long, text string, may_be int")
    gone = spark.createDataFrame([(i,) for i in range(0, 50, 3)], "doc_id long")
    left = common.without(df, gone)
    assert left.columns == df.columns and {r[0] for r in left.collect()} == {i for i in range(50) if i % 3}
    side = common.cut(gone.withColumn("x", F.lit(1)))
    assert {r["doc_id"]: r["x"] for r in common.with_side(df, side).collect()} == {i: None if i % 3 else 1 for i in range(50)}
    assert {r["doc_id"] for r in exact.keep_largest(df).collect()} == set(range(43, 50))


def test_texts_do_not_shuffle_between_stages(spark):
    """In the plan of a filter, texts that certainly stay pass no exchange."""
    df = common.cut(spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text")))
    out = common.without(df, df.select("doc_id").where("doc_id % 10 = 0"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    rest = plan[: plan.index("LeftAnti")] if "LeftAnti" in plan else plan
    assert "Union" in plan and rest.count("Exchange hashpartitioning") == 0
    assert out.count() == 900


def test_a_cluster_must_name_its_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "a"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session())


@pytest.mark.parametrize("together", [500_000, 100, 0])
def test_components_of_few_links_take_few_tables(spark, monkeypatch, together):
    """However long the paths are, links that fit one task are written twice; larger tables go through rounds, with the same result."""
    import importlib
    import random

    module, written = importlib.import_module("eventloom.llm.components"), []
    links = [(i, i + 1) for i in range(1, 200)] + [(i + 3, i) for i in range(300, 360)] + [(7, 7), (1, 2), (400, 400), (-5, 9_000_000_000)]
    names = [*range(1, 401)]
    random.Random(3).shuffle(names)
    links = [(names[a - 1], names[b - 1]) if 0 < a <= 400 and 0 < b <= 400 else (a, b) for a, b in links]
    of = {i: i for a, b in links if a != b for i in (a, b)}
    for _ in of:
        for a, b in links:
            if a != b:
                of[a] = of[b] = min(of[a], of[b])
    monkeypatch.setattr(module, "TOGETHER", together, raising=False)
    monkeypatch.setattr(module, "cut", lambda df, f=module.cut: written.append(1) or f(df))
    got = module.components(spark.createDataFrame(links, "a long, b long").repartition(3))
    assert {(r["id"], r["component"]) for r in got.collect()} == set(of.items()) and got.count() == len(of)
    assert (len(written) == 2) == (together == 500_000)
    assert module.components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0
