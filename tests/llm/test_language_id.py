import numpy as np
from pyspark.sql import functions as F

from vellum.llm import language_id as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify_held_out(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert 200 < len(held) < 500
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.02


def test_a_small_sample_is_learned_as_well(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = L.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.97
    assert not any(r.rejected for r in rows if r.lang_pred != "und")


def test_rejects_what_is_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs)
    odd = [None, "", " \n", "12345 !!! ??", "中文", "qxzj vkqz jxqw zzqk " * 30]
    found = {r.doc_id: r for r in L.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()}
    assert [found[i].lang_pred for i in range(4)] == ["und"] * 4
    assert [found[i].score for i in range(4)] == [0.0] * 4
    assert all(found[i].rejected for i in range(4)) and found[5].rejected
    assert found[4].lang_pred in model.languages


def test_empty_and_unlabelled_tables(spark):
    schema = "doc_id long, text string, lang string, rejected string, label string"
    none = spark.createDataFrame([], schema)
    assert L.identify_held_out(none).count() == 0
    rows = spark.createDataFrame([(1, "some words", None, "x", "y"), (1, "some words", None, "x", "y"), (None, None, "en", None, None)], schema)
    assert sorted(tuple(r)[2:4] for r in L.identify_held_out(rows).collect()) == [("und", 0.0)] * 3


def test_a_language_not_learned_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    model = L.fit(docs.where("lang <> 'de'"))
    found = L.identify(docs, model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert np.mean([r.rejected for r in found if r.lang == "de" and r.n_chars > 100]) > 0.9
    assert np.mean([r.rejected for r in found if r.lang != "de"]) < 0.02
    assert {r.lang for r in L.accepted(docs, model).select("lang").distinct().collect()} >= {"en", "es", "fr"}


def test_long_texts_of_a_learned_language_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    model = L.fit(docs)
    assert model.least_seen < 0.99
    long = docs.groupBy("lang").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    assert L.accepted(long, model).count() == 4


def test_every_language_is_learned():
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for k in range(300):
        words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(20)]
        for _ in range(6):
            texts.append(" ".join(rng.choice(words, 40)))
            labels.append(f"l{k:03d}")
    model = L.train(texts, labels)
    assert len(model.languages) == 300
    found = model.predicted(*L._joined([t.encode() for t in texts]))[0]
    assert np.mean([model.languages[i] == label for i, label in zip(found, labels)]) > 0.95


def test_sampled_texts_are_bounded_and_spread(spark):
    long = "".join(chr(97 + i // 10_000) for i in range(260_000))
    docs = spark.createDataFrame([(1, long, "xx"), (2, "short", "xx"), (3, None, "xx"), (4, "none", None)], "doc_id long, text string, lang string")
    got = sorted(r.text for r in L.labelled_sample(docs, "text", "lang", "doc_id").collect())
    assert len(got) == 2 and got[1] == "short" and len(got[0]) == L.SPREAD * L.PIECE + L.SPREAD - 1
    assert {"a", "m", "z"} <= set(got[0])


def test_without_a_model_only_texts_without_a_letter_go(spark):
    docs = spark.createDataFrame([(1, "words", 5), (2, "12", 5), (3, None, 5), (4, "x" * 3_000_000, 5)], "doc_id long, text string, label int")
    assert sorted(r.doc_id for r in L.accepted(docs, None).collect()) == [1, 4]
