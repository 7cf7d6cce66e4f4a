import random

import numpy as np
from pyspark.sql import functions as F

from dawnpress.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, rows = found.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert rows > 200 and right / rows > 0.97


def test_labels_of_the_held_out_fold_are_not_used(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    fold = language.remainder(F.col("doc_id"), language.FOLDS) == language.HELD_OUT
    wrong = docs.withColumn("lang", F.when(fold, F.lit("xx")).otherwise(F.col("lang")))
    plain = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language.held_out_languages(docs).collect()}
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language.held_out_languages(wrong).collect()} == plain


def test_edges(spark):
    schema = "doc_id long, text string, lang string"
    assert language.held_out_languages(spark.createDataFrame([], schema)).collect() == []
    rows = [(i, f"the words of the text number {i} and more", "en") for i in range(40)] + [(100 + i, f"les mots du texte numéro {i} et encore", "fr") for i in range(40)]
    rows += [(500, None, "en"), (501, "", None), (502, "12 34 !!", "en"), (503, "日本語", None), (None, "the words", None), (504, "des mots", "fr"), (504, "des mots", "fr")]
    found = language.held_out_languages(spark.createDataFrame(rows, schema).withColumn("score", F.lit(1)))
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {got[i][0].lang_pred for i in (500, 501, 502)} == {"und"} and got[501][0].score == 0
    assert got[503][0].lang_pred in ("en", "fr") and got[503][0].rejected and len(got[504]) == 2
    assert got[None][0].lang_pred == "en" and got[504][0].lang_pred == "fr"
    unknown = spark.createDataFrame([(1, "text", None)], schema)
    assert [r.lang_pred for r in language.held_out_languages(unknown).collect()] == ["und"]


def test_kmeans_separates():
    points = np.eye(6)[[0, 0, 1, 1, 2, 2]] + 0.01
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centroids = language.spherical_kmeans(points, 3)
    assert sorted((points @ centroids.T).argmax(axis=1).tolist()) in ([0, 0, 1, 1, 2, 2],)


def test_every_language_is_learned_in_blocks(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    found = lambda: {r.doc_id: (r.lang_pred, round(r.score, 4), r.rejected) for r in language.held_out_languages(docs).collect()}
    whole = found()
    assert len({lang for lang, *_ in whole.values()} - {"und"}) > 2
    monkeypatch.setattr(language, "LANGUAGES", 1)
    blocks = found()
    assert {k: v[::2] for k, v in blocks.items()} == {k: v[::2] for k, v in whole.items()}
    assert all(abs(blocks[k][1] - v[1]) < 2e-4 for k, v in whole.items())


def test_null_and_repeated_ids_teach_a_language(spark):
    draw = random.Random(3)
    words = {"en": "the and of house water river mountain".split(), "de": "der und von haus wasser fluss berge".split()}
    rows = [(7 if lang == "de" else None, " ".join(draw.choices(some, k=30)), lang) for lang, some in words.items() for _ in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(docs, language.train(docs))
    got = sorted((r.lang_pred, r.doc_id or 0) for r in found.collect())
    assert got == sorted([("de", 7)] * 40 + [("en", 0)] * 40)
