"""Odd tables: ties, repeated rows, null and repeated ids, empty tables, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chat_format, html_text, quality_knn

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in is that for it on with as was at by this be from or are which had not but what all were when".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed", "ly"]) for _ in range(n))


def test_equal_similarity_of_both_labels(frame):
    rng = random.Random(1)
    texts = [prose(rng, 30) for _ in range(4)] * 2  # each text once with either label
    docs = frame([(k, t) for k, t in enumerate([*texts, texts[0], None, ""])], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = frame([(k, k // 4) for k in range(8)], "doc_id long, quality int")
    runs = []
    for parts in (1, 5):
        model = quality_knn.fit(docs.repartition(parts), labels.repartition(parts))
        runs.append({r.doc_id: round(r.score, 9) for r in quality_knn.predict(docs.repartition(parts), model).collect()})
    assert runs[0] == runs[1] and all(0 <= s <= 1 for s in runs[0].values()) and runs[0][8] == runs[0][0] == runs[0][4]
    assert runs[0][9] == runs[0][10] == 0.5
    assert quality_knn.predict(docs.limit(0), model).count() == 0


def test_chats_without_id_and_repeated_rows(frame):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (7, 0, "user", "x"), (7, 0, "user", "x"), (7, 1, "assistant", None), (8, None, "user", "only")]
    df = frame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.turns for r in chat_format.format_chats(df).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in got[None]] == [("user", "a"), ("assistant", "b")]
    assert [(t.role, t.text) for t in got[7]] == [("user", "x"), ("user", "x"), ("assistant", "")] and len(got[8]) == 1
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_repeated_pages(frame):
    page = "<article><p>The old town of the region was built in the years after the war, and it is known for all of the houses.</p></article>"
    rows = html_text.extract(frame([(1, "u", page), (1, "u", page), (None, None, page)], "page_id long, url string, html string")).collect()
    assert len(rows) == 3 and len({r.text for r in rows}) == 1 and rows[0].text.startswith("The old town")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    texts = [prose(rng, 80) for _ in range(30)]
    rows = [(k % 20, t, "en", rng.choice(["a", "b", None]), len(t)) for k, t in enumerate(texts)]  # ids 0 to 9 twice, with other texts
    rows += [(0, texts[0], "en", "a", 1), (None, texts[1], "en", "a", 1), (None, prose(rng, 80), "en", "b", 1), (50, texts[2].upper(), "en", "a", 1), (51, None, "en", "a", 0), (52, "", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("_mix_copies", "kept", "node", "component_id", "n")}), texts


def test_stages_on_repeated_and_null_ids_and_clashing_names(spark, odd):
    docs, texts = odd
    before = docs.columns
    kept = corpus_pipeline.rules(spark, docs, SF)
    assert kept.columns == before and {51, 52}.isdisjoint({r.doc_id for r in kept.collect()})
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    rows = one.collect()
    assert one.columns == before and sorted(r.text for r in rows if r.doc_id is not None) == sorted(texts) and sum(r.doc_id is None for r in rows) == 1
    clean = corpus_pipeline.benchmark(spark, one, SF)
    assert clean.columns == before and clean.count() == 31
    mixed = corpus_pipeline.mix(spark, clean, SF)
    assert mixed.columns == before and mixed.select("text").distinct().count() == 31
    assert corpus_pipeline.token_ids(spark, mixed, SF).count() == mixed.count()


def test_stages_on_an_empty_table(spark, odd):
    docs = odd[0].select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
