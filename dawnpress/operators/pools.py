"""Article pools: best copy per link, freshest-first clusters, daily pool, rolling active pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnpress.functions import text as T
from dawnpress.operators.frames import first_per_key, sequence_number, top_per_key

POOL_SIZE = 140
NEW_PER_DAY = 20


def freshness() -> list[Column]:
    return [F.asc("recency_bucket"), F.desc("item_id")]


def best_copies(inventory: DataFrame) -> DataFrame:
    """One row per non-blank link: the freshest copy, then the highest id."""
    linked = inventory.withColumn("link", T.strip(T.text_or_empty(F.col("link")))).where("link <> ''")
    return first_per_key(linked, ["link"], freshness())


def cluster_links(inventory: DataFrame, top: int | None = None) -> DataFrame:
    """Distinct links of each cluster in freshness order as (cluster_id, link_rank, link, item_id, recency_bucket)."""
    linked = (
        inventory.withColumn("link", T.strip(T.text_or_empty(F.col("link"))))
        .where("link <> ''")
        .withColumn("cluster_id", T.cluster_id(F.col("topic_name")))
        .select("cluster_id", "link", "item_id", "recency_bucket")
    )
    distinct = first_per_key(linked, ["cluster_id", "link"], freshness())
    if top is not None:
        return top_per_key(distinct, ["cluster_id"], freshness(), top, "link_rank")
    chunk = F.struct("recency_bucket", -F.floor(F.col("item_id") / 65_536))
    return sequence_number(distinct, ["cluster_id"], freshness(), chunk, "link_rank")


def bootstrap_pools(inventory: DataFrame, size: int = POOL_SIZE) -> DataFrame:
    """First pools of every cluster; the day's allowance counts as used."""
    return cluster_links(inventory, size).select(
        "cluster_id", F.col("link_rank").cast("bigint").alias("queue_pos"), "link", F.lit(NEW_PER_DAY).alias("new_added_today")
    )


def refresh_pools(
    pools: DataFrame,
    inventory: DataFrame,
    day_changed: bool,
    size: int = POOL_SIZE,
    per_day: int = NEW_PER_DAY,
    evict: str = "oldest",
) -> DataFrame:
    """Drop unknown links, add fresh ones within the day's allowance, evict above the target size.

    ``pools`` is (cluster_id, queue_pos, link, new_added_today); pools are at most ``size`` rows per cluster, so only
    ``size + per_day`` candidates per cluster can matter. ``evict="stalest"`` removes the least fresh links instead of
    the ones queued first.
    """
    used = F.lit(0) if day_changed else F.col("new_added_today")
    counters = pools.groupBy("cluster_id").agg(F.max("new_added_today").alias("new_added_today"))
    counters = counters.select("cluster_id", used.alias("used"))
    known = best_copies(inventory).select("link", "recency_bucket", "item_id")
    kept = pools.select("cluster_id", "queue_pos", "link").join(known, "link")
    ranked = cluster_links(inventory, size + per_day)
    unseen = ranked.join(kept.select("cluster_id", "link"), ["cluster_id", "link"], "left_anti")
    allowance = unseen.join(counters, "cluster_id", "left").withColumn(
        "allowance", F.greatest(F.lit(per_day) - F.coalesce("used", F.lit(0)), F.lit(0))
    )
    order = Window.partitionBy("cluster_id").orderBy("link_rank")
    added = allowance.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("allowance"))
    tail = kept.groupBy("cluster_id").agg(F.max("queue_pos").alias("_tail"))
    queued = added.join(tail, "cluster_id", "left").select(
        "cluster_id",
        (F.coalesce("_tail", F.lit(0)) + F.col("_n")).cast("bigint").alias("queue_pos"),
        "link",
        "recency_bucket",
        "item_id",
        F.lit(1).alias("_new"),
    )
    both = kept.select("cluster_id", "queue_pos", "link", "recency_bucket", "item_id", F.lit(0).alias("_new"))
    both = both.unionByName(queued)
    grown = both.groupBy("cluster_id").agg(F.sum("_new").alias("_added"))
    survivors = [F.desc("queue_pos")] if evict == "oldest" else freshness()
    final = top_per_key(both, ["cluster_id"], survivors, size, "_keep").drop("_keep")
    total = grown.join(counters, "cluster_id", "left").select(
        "cluster_id", (F.coalesce("used", F.lit(0)) + F.col("_added")).cast("int").alias("new_added_today")
    )
    return final.join(total, "cluster_id").select("cluster_id", "queue_pos", "link", "new_added_today")


def daily_pool(articles: DataFrame, k: int = 150, top_n: int = 800) -> DataFrame:
    """The shared menu of the day: distinct links, newest first (unreadable dates last), at most ``k``."""
    usable = articles.where((T.strip(F.col("link")) != "") & (T.strip(F.col("headline")) != ""))
    distinct = first_per_key(usable, ["link"], ["pos"])
    window = distinct.orderBy(F.desc_nulls_last("published_utc"), "pos").limit(max(k, top_n))
    ordered = Window.orderBy(F.desc_nulls_last("published_utc"), "pos")
    return window.withColumn("pool_rank", F.row_number().over(ordered)).where(F.col("pool_rank") <= k)


def pool_document(pool: DataFrame, now: Column) -> DataFrame:
    """The daily pool as one JSON document (``k`` entries at most)."""
    item = F.struct(
        "pool_rank",
        T.strip(F.col("headline")).alias("title"),
        T.strip(F.col("summary")).alias("summary"),
        T.strip(F.col("link")).alias("link"),
        F.date_format("published_utc", "yyyy-MM-dd HH:mm:ss").alias("published"),
    )
    items = F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("pool_rank"))
    return pool.agg(items.alias("items")).select(
        F.to_json(
            F.struct(
                F.lit(1).alias("version"),
                F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at_utc"),
                F.date_format(now, "yyyy-MM-dd").alias("day_utc"),
                F.size("items").alias("size"),
                "items",
            )
        ).alias("value")
    )


def pool_universe(documents: DataFrame, copies: DataFrame, size: int = 150) -> DataFrame:
    """Pool documents back to inventory rows: first occurrence of each known link, at most ``size``."""
    schema = "day_utc string, items array<struct<title:string,summary:string,link:string,published:string>>"
    entries = documents.select(F.from_json("value", schema).alias("d")).select(
        "d.day_utc", F.posexplode("d.items").alias("place", "item")
    )
    links = entries.select("day_utc", "place", T.strip(F.col("item.link")).alias("link")).where("link <> ''")
    known = links.join(copies, "link")
    first = first_per_key(known, ["day_utc", "item_id"], ["place"])
    return top_per_key(first, ["day_utc"], ["place"], size, "pool_rank")
