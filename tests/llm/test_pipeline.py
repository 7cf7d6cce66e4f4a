import corpus_pipeline as pipeline
from pyspark.sql import functions as F


def test_stages_follow_one_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    sizes = []
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, sf))
        sizes.append(docs.count())
        assert name == "packing" or docs.columns == names
    assert sizes[1] <= sizes[0] and sizes[2] == sizes[1] and sizes[4] >= sizes[3]
    assert docs.where("length > 4096").count() == 0
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]


def test_odd_rows_pass(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (70_000, "", "en", None, 0), (70_000, "", "en", None, 0), (70_001, "mail a@b.cd", None, "zz", 11)], docs.schema)
    docs = docs.limit(80).unionByName(odd).withColumn("row", F.lit(1)).withColumn("score", F.lit(2.0))
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, sf))
        assert docs.columns[-2:] == ["row", "score"], name
    assert docs.where("text LIKE '%a@b.cd%'").count() == 0


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, sf))
    assert docs.count() == 0


def test_near_copies_of_five_word_shingles_are_dropped(spark, sf):
    words = [f"word{i * i % 1009}" for i in range(600)]
    copy = ["edited" if i % 60 == 30 else w for i, w in enumerate(words)]  # ten edits, similarity 546 / 646
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy))], "doc_id long, text string")
    assert [r.doc_id for r in pipeline.drop_near_copies(spark, docs, sf).collect()] == [1]
    assert {r.component_id for r in pipeline.simhash.near_duplicates(docs).collect()} == {1, 2}  # op5's ball misses it
