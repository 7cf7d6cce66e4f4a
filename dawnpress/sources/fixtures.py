"""The canonical tables of the engine, derived from the generic test tables.

Each function is a lazy mapping: columns that a query does not use are pruned down to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnpress.functions import numeric as N
from dawnpress.functions import text as T
from dawnpress.functions import wordlists as W
from dawnpress.operators.frames import sequence_number
from dawnpress.session import utc

NOW = "2024-02-01 00:00:00"
#: Runs of blanks other than a single space: replacing these gives the same as replacing every run of blanks. One class is tried on a letter.
UNTIDY = r"[ \t\n\x0B\f\r](?:(?<! )\s*|\s+)"
#: The first twelve words before blanks are tidied, so that a headline needs no pass over the whole text.
FIRST_WORDS = r"^\s*((?:\S+\s+){0,11}\S+)"
STYLES = [*W.EMOTION_STYLES.values(), W.DEFAULT_STYLE]


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """The same rows over all tasks: a small file is one row group and thus one task, whatever is computed of each row."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """One article per document: the first twelve words are the headline, all other words the summary."""
    return articles_of(table(spark, sf, "documents"))


def articles_of(doc: DataFrame) -> DataFrame:
    tidy = F.trim(F.regexp_replace("text", UNTIDY, " "))
    published = F.expr(f"timestamp'{NOW}' - make_dt_interval(0, 0, cast(doc_id * 7919 % 43200 as int), 0)")
    link = F.concat(
        F.lit("https://www."),
        "source",
        F.lit(".example.com/"),
        "lang",
        F.lit("/"),
        (F.col("doc_id") % 900).cast("string"),
        F.lit("?ref="),
        F.col("doc_id").cast("string"),
    )
    base = doc.select("doc_id", "source", "text", tidy.alias("tidy"), link.alias("link"), published.alias("published_utc"))
    return base.select(
        F.col("doc_id").alias("item_id"),
        F.col("doc_id").alias("pos"),
        F.regexp_replace(F.regexp_extract("text", FIRST_WORDS, 1), UNTIDY, " ").alias("headline"),
        F.ltrim(F.regexp_replace("tidy", r"^(?:[^ ]+ ){0,11}[^ ]+", "")).alias("summary"),
        "link",
        "published_utc",
        F.concat("source", F.lit(".example.com")).alias("topic_name"),
        F.substring("source", 4, 10).cast("int").alias("topic_id"),
        F.element_at(T.words_in(STYLES), (F.col("doc_id") % 8 + 1).cast("int")).alias("vibe_style"),
        (F.col("doc_id") % 8).cast("int").alias("vibe_id"),
        (F.col("doc_id") % 64).cast("int").alias("topic_cluster_id"),
        F.concat(F.lit("Entity Group "), (F.col("doc_id") % 19).cast("string")).alias("entity_key"),
        F.concat(F.lit("event_"), (F.col("doc_id") % 13).cast("string")).alias("event_key"),
        N.recency_bucket(N.hours_between(now(), F.col("published_utc"))).alias("recency_bucket"),
        (F.col("doc_id") % 4).cast("int").alias("popularity_bucket"),
    )


def article_count(spark: SparkSession, sf: str):
    return table(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()


def interaction_events(spark: SparkSession, sf: str) -> DataFrame:
    """Interactions without article columns: step, dwell, reason and flags per session."""
    dwell = F.least(F.lit(10.0), F.col("value") / 10)
    events = table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("seg"), (F.col("user_id") % 4).cast("string")).alias("user_type"),
        F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("condition"),
        F.col("ts").cast("timestamp").alias("ts"),
        dwell.alias("dwell"),
        F.when(F.col("event_type") == "purchase", "auto")
        .when(F.col("event_type") == "signup", "other")
        .otherwise("skip")
        .alias("reason"),
    )
    stepped = sequence_number(events, ["session_id"], ["ts", "event_id"], F.to_date("ts"), "step")
    return stepped.select(
        "*",
        F.when(F.col("reason") == "auto", 10.0).otherwise(N.watch_reward(F.col("dwell"))).alias("reward"),
        (F.col("dwell") / 10).alias("interest"),
    )


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """The interaction log: events with the article they refer to."""
    item = (F.col("event_id") * 31 % article_count(spark, sf)).alias("item_id")
    events = interaction_events(spark, sf).select("*", item)
    wanted = articles(spark, sf).select(
        "item_id", "topic_id", "topic_name", "vibe_id", "vibe_style", "topic_cluster_id", "headline", "recency_bucket"
    )
    return events.join(wanted, "item_id")


def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label"
    )


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def delivered(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered audio per conversation turn, with the feedback that follows it."""
    base = conversations(spark, sf).select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("position"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("content_id"),
        (F.col("conv_id") * 8 + F.col("turn")).alias("item_id"),
        T.four_sentences(F.col("text")).alias("sentences"),
        F.when(F.col("turn") % 5 != 4, (F.col("turn") % 5).cast("int")).alias("skip_index"),
        F.when(F.col("turn") % 3 != 0, F.length("text") * 10.0).alias("listen_ms"),
        F.when(F.col("turn") % 3 != 0, F.lit(10000.0)).alias("total_ms"),
    )
    return base


def reader_events(spark: SparkSession, sf: str) -> DataFrame:
    return conversations(spark, sf).select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("position"),
        (F.col("turn") % 4).cast("int").alias("sentence_index"),
        F.when(F.col("role") == "assistant", "read_sentence")
        .when(F.col("role") == "user", "skip_article")
        .otherwise("complete_article")
        .alias("action"),
        T.four_sentences(F.col("text")).alias("sentences"),
    )


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profile documents in three collections and four shapes."""
    customer = dealt(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    seg, nat = F.col("c_mktsegment"), F.col("n_name")
    shapes = [
        F.format_string('{"preferences":{"interests":["%s","%s"]},"commute":"short"}', seg, nat),
        F.format_string('{"interests":"%s, %s , %s","profile":{"commuteBucket":"long"}}', seg, nat, F.lower(seg)),
        F.format_string('{"onboarding":{"topics":[{"name":"%s"},{"x":1,"label":" %s "},7]}}', seg, nat),
        F.format_string('{"news_preferences":{"categories":["%s"],"trip_length":" train "},"topics":["%s"]}', nat, seg),
    ]
    shape = F.col("c_custkey") % 4
    document = F.when(shape == 0, shapes[0]).when(shape == 1, shapes[1]).when(shape == 2, shapes[2]).otherwise(shapes[3])
    return customer.join(nation, "c_nationkey").select(
        F.col("c_custkey").cast("string").alias("uid"),
        (F.col("c_custkey") % 3).cast("int").alias("collection"),
        document.alias("document"),
    )
