"""File edges: what is written to the shared folder and read back must equal the tables it came from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnpress.catalog.base import query
from dawnpress.catalog.clustering import CORES, MEMBERS, cores_of
from dawnpress.catalog.sql import ARTICLES, INTERACTIONS, with_tables
from dawnpress.functions import wordlists as W
from dawnpress.session import shared_folder
from dawnpress.sources import files
from dawnpress.sources import fixtures as X
from dawnpress.sources import snapshots

C = F.col


def folder(spark: SparkSession) -> str:
    """A new folder of this run below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/edge-{uuid.uuid4().hex}"


@query(
    "feed_files",
    with_tables(" SELECT link, headline, md5(summary) AS summary, item_id % 2 = 1 AS dated FROM articles", ARTICLES),
)
def _feed_files(spark, sf):
    """Even articles as RSS items, odd ones as Atom entries that only have an update time."""
    path, rows = folder(spark), X.articles(spark, sf)
    rss = rows.where("item_id % 2 = 0").select(C("headline").alias("title"), C("summary").alias("description"), "link")
    rss.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(f"{path}/rss")
    stamp = F.date_format("published_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated")
    atom = rows.where("item_id % 2 = 1").select(C("headline").alias("title"), "summary", stamp, F.struct(C("link").alias("_href")).alias("link"))
    atom.write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(f"{path}/atom")
    feeds = files.read_feeds(spark, f"{path}/*")
    return feeds.select("link", "headline", F.md5("summary").alias("summary"), (C("published") != "").alias("dated"))


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """The inventory as a CSV file with quotes and line breaks inside fields."""
    path = folder(spark)
    broken = F.concat(F.lit('say "'), "headline", F.lit('",\nthen'))
    rows = X.articles(spark, sf).select(
        C("item_id").alias("Item_ID"), broken.alias("Headline"), C("summary").alias("Summary"), C("link").alias("Link"),
        F.date_format("published_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Published_UTC"),
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.read_inventory(spark, path)


@query(
    "inventory_file",
    with_tables(
        """ SELECT link, md5('say "' || headline || '",' || chr(10) || 'then') AS headline, strftime(published_utc, '%Y-%m-%d %H:%M') AS published FROM articles""",
        ARTICLES,
    ),
)
def _inventory_file(spark, sf):
    rows = files.canonical_inventory(inventory(spark, sf))
    return rows.select("link", F.md5("headline").alias("headline"), F.date_format("published_utc", "yyyy-MM-dd HH:mm").alias("published"))


@query(
    "feature_table_file",
    with_tables(
        """ SELECT CAST(item_id AS VARCHAR) AS item_id, md5(headline) AS headline, md5(summary) AS summary, link, CAST(topic_id AS VARCHAR) AS topic_id, vibe_style
FROM articles""",
        ARTICLES,
    ),
)
def _feature_table_file(spark, sf):
    """The feature table as written for other tools: a CSV file of seventeen columns in their fixed order."""
    path, rows = folder(spark), X.articles(spark, sf)
    missing = [c for c in W.ARTICLE_COLUMNS if c.lower() not in {n.lower() for n in rows.columns}]
    files.write_features(rows.withColumns({c: F.lit("") for c in missing}), path, "csv")
    back = files.read_inventory(spark, path)
    if back.columns != list(W.ARTICLE_COLUMNS):
        raise ValueError(f"columns of the file: {back.columns}")
    text = lambda name: F.md5(F.coalesce(name, F.lit(""))).alias(name.lower())
    return back.select(C("Item_ID").alias("item_id"), text("Headline"), text("Summary"), C("Link").alias("link"), C("Topic_ID").alias("topic_id"), C("Vibe_Style").alias("vibe_style"))


@query(
    "demand_headlines",
    with_tables(""" SELECT md5('say "' || headline || '",' || chr(10) || 'then') AS headline, count(*) AS n FROM articles GROUP BY 1""", ARTICLES),
)
def _demand_headlines(spark, sf):
    rows = files.inventory_for_demand(inventory(spark, sf))
    return rows.groupBy(F.md5("headline").alias("headline")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "interaction_log",
    with_tables(
        """ SELECT session_id, step, item_id, topic_name, round(reward, 6) AS reward, strftime(ts, '%Y-%m-%d') AS day, false AS has_epsilon FROM interactions""",
        INTERACTIONS,
    ),
)
def _interaction_log(spark, sf):
    """Two appends of one half each; columns that the source lacks are there and null."""
    path, rows = folder(spark), X.interactions(spark, sf).withColumn("timestamp_utc", C("ts"))
    for half in range(2):
        files.append_interactions(rows.where(C("event_id") % 2 == half), path)
    back = spark.read.parquet(path)
    return back.select(
        "session_id", "step", "item_id", "topic_name", F.round("reward", 6).alias("reward"), C("day").cast("string").alias("day"),
        C("epsilon").isNotNull().alias("has_epsilon"),
    )


@query(
    "label_cache_file",
    with_tables(" SELECT 'k' || item_id AS key, CASE WHEN item_id % 3 = 0 THEN topic_name ELSE vibe_style END AS event FROM articles", ARTICLES),
)
def _label_cache_file(spark, sf):
    """A record for every article, unreadable lines between them, and a later record for every third, in ordered part files."""
    path, rows = folder(spark), X.articles(spark, sf)
    record = lambda event: F.to_json(F.struct(F.concat(F.lit("k"), "item_id").alias("key"), C(event).alias("event")))
    first = rows.select((C("item_id") * 2).alias("at"), record("vibe_style").alias("value"))
    broken = rows.select((C("item_id") * 2 + 1).alias("at"), F.lit("{broken").alias("value"))
    later = rows.where("item_id % 3 = 0").select((C("item_id") + (1 << 40)).alias("at"), record("topic_name").alias("value"))
    first.unionByName(broken).unionByName(later).repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)
    return files.read_label_cache(spark, path)


@query(
    "pool_snapshot",
    with_tables(" SELECT link, topic_name FROM articles WHERE item_id % 3 <> 0 AND topic_id <> 3", ARTICLES),
)
def _pool_snapshot(spark, sf):
    """The later of two versions counts; links that the inventory no longer has go."""
    path, rows = folder(spark), X.articles(spark, sf)
    pools = rows.select("item_id", "link", "topic_name")
    snapshots.write_snapshot(pools, path)
    snapshots.write_snapshot(pools.where("item_id % 3 <> 0"), path)
    latest = snapshots.latest_snapshot(spark, path)
    return snapshots.known_links_only(latest, rows.where("topic_id <> 3")).select("link", "topic_name")


@query(
    "wishlist_file",
    with_tables(
        """,
t AS (SELECT DISTINCT topic_name FROM articles)
SELECT string_agg('more ' || topic_name, '|' ORDER BY topic_name) AS queries, string_agg(topic_name, '|' ORDER BY topic_name) AS domains, '' AS urls FROM t""",
        ARTICLES,
    ),
)
def _wishlist_file(spark, sf):
    """One document of lists with blanks, spaces and repeats; one list is missing."""
    path = folder(spark)
    topics = F.sort_array(F.collect_set("topic_name"))
    padded = F.transform(topics, lambda t: F.concat(F.lit(" more "), t, F.lit("  ")))
    lists = F.struct(F.concat(padded, F.array(F.lit(" ")), padded).alias("queries"), F.concat(topics, topics).alias("preferred_domains"))
    document = X.articles(spark, sf).agg(F.to_json(lists).alias("value"))
    document.coalesce(1).write.text(path)
    joined = lambda name, out: F.array_join(name, "|").alias(out)
    back = files.read_wishlist(spark, path)
    return back.select(joined("queries", "queries"), joined("preferred_domains", "domains"), joined("extra_feed_urls", "urls"))


@query(
    "story_report",
    with_tables(
        " SELECT printf('- size: %d, cohesion: %.3f, src_div: %d, age_days: %.2f', size, cohesion, source_diversity, age_days) AS line FROM cores",
        ARTICLES,
        MEMBERS,
        CORES,
    ),
)
def _story_report(spark, sf):
    """The written report holds one line of measures per cluster."""
    path = folder(spark)
    files.write_report(files.markdown_report(cores_of(spark, sf), "Story clusters", {"k": 10}), path)
    return spark.read.text(path).where("value LIKE '- size:%'").select(C("value").alias("line"))


@query(
    "reader_event_log",
    """ SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS position, CAST(turn % 4 AS INTEGER) AS sentence_index,
  CASE role WHEN 'assistant' THEN 'read_sentence' WHEN 'user' THEN 'skip_article' ELSE 'complete_article' END AS action FROM conversations""",
)
def _reader_event_log(spark, sf):
    path, rows = folder(spark), X.reader_events(spark, sf).select("session_id", "position", "sentence_index", "action")
    for half in range(2):
        files.append_json(rows.where(C("position") % 2 == half), path)
    return spark.read.schema(rows.schema).json(path)
