from pyspark.sql import functions as F

from dawnpress.llm import toxicity

CLEAN = "the people of the town went on with their work and then home again"


def marked(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        insult = f" you are a zork{'abcdef'[i % 6]}x and an idiot" if toxic else f" number {i} is fine"
        rows.append((i, (CLEAN + " ") * (1 + i % 5) + insult, "src", "en"))
        labels.append((i, int(toxic)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_held_out_documents(spark):
    docs, labels = marked(spark)
    scored = toxicity.train(docs, labels).score(docs, "doc_id").join(labels, "doc_id")
    assert scored.where("predicted <> toxic").count() <= 6
    assert scored.where("score < 0 OR score > 1 OR (score >= 0.5) <> (predicted = 1)").count() == 0
    kept = toxicity.keep_clean(docs.withColumn("features", F.lit(1)).withColumn("prediction", F.lit(2)), labels)
    assert kept.columns == [*docs.columns, "features", "prediction"] and 440 <= kept.count() <= 460


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = marked(spark, 400)
    fold = toxicity.remainder(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT
    wrong = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: {r.doc_id: r.score for r in toxicity.train(docs, x).score(docs, "doc_id").collect()}
    assert score(labels) == score(wrong)


def test_edges(spark):
    docs, labels = marked(spark)
    odd = spark.createDataFrame([(None, None, None, None), (9001, "", None, None), (9001, "", None, None), (9002, "é" * 50_000, "s", "x")], docs.schema)
    scorer = toxicity.train(docs.union(odd), labels.union(spark.createDataFrame([(None, 1), (77, None), (123456, 1), (0, 0)], labels.schema)))
    got = scorer.score(docs.union(odd), "doc_id")
    assert got.count() == 604 and got.where("score IS NULL").count() == 0
    empty = docs.limit(0)
    assert scorer.score(empty, "doc_id").collect() == []
    untaught = toxicity.train(docs, labels.limit(0)).score(docs, "doc_id")
    assert [tuple(r) for r in untaught.select("score", "predicted").distinct().collect()] == [(0.0, 0)]


def test_features():
    plain = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT!! such a l0ser", toxicity.Lexicon({b"loser": 1.0})), strict=True))
    assert plain["insult_hits"] > 0 and plain["nearness"] == 0.5 and plain["disguised"] > 0 and plain["disguised_hits"] == 1
    assert toxicity.features(None, toxicity.Lexicon({})) == [0.0] * len(toxicity.FEATURES)


def test_lexicon():
    lexicon = toxicity.Lexicon({b"loser": 2.0, b"zork*": 3.0})
    assert lexicon.hits([b"a", b"loser", b"zorking", b"zor"]) == ([1, 2], [2.0, 3.0])


def test_a_run_of_letters_is_read_once():
    import time

    start = time.time()
    assert toxicity.MIXED.findall(b"a" * 1_000_000 + b"1 " + b"b1" * 300_000 + b"c d0g x" + b"1" * 300_000) == [b"b1" * 300_000 + b"c", b"d0g"]
    assert time.time() - start < 2
