"""Feature columns of the article inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnpress.functions import numeric as N
from dawnpress.functions import text as T
from dawnpress.functions import wordlists as W
from dawnpress.operators.frames import global_position
from dawnpress.session import cut_lineage

CHUNK_ROWS = 65_536
# Id columns that the inventory must carry as non-negative integers.
ID_COLUMNS = (
    "item_id topic_id vibe_id topic_cluster_id entity_id event_id recency_bucket popularity_bucket"
).split()
# Alternative column names of landed inventories.
ALIASES = {
    "item_id": ["Item_ID"],
    "headline": ["Headline", "title"],
    "summary": ["Summary", "description"],
    "link": ["Link"],
    "published": ["Published", "Published_UTC", "published_utc"],
    "emotion": ["Emotion"],
    "vibe_style": ["Suggested_Style", "Vibe_Style"],
    "topic_name": ["Topic_Name"],
}


def reconcile(raw: DataFrame) -> DataFrame:
    """Landed inventory in canonical text columns: first existing spelling, else derived, else empty."""

    def pick(name: str) -> Column | None:
        for spelling in [name, *ALIASES.get(name, [])]:
            if spelling in raw.columns:
                return F.col(f"`{spelling}`").cast("string")
        return None

    text = {n: T.text_or_empty(pick(n)) if pick(n) is not None else F.lit("") for n in ("headline", "summary", "link")}
    mood = pick("emotion")
    mood = mood if mood is not None else T.emotion(text["headline"])
    style = pick("vibe_style")
    style = F.coalesce(style, F.lit(W.DEFAULT_STYLE)) if style is not None else T.style_of_emotion(mood)
    published = pick("published")
    return raw.select(
        text["headline"].alias("headline"),
        text["summary"].alias("summary"),
        mood.alias("emotion"),
        style.alias("vibe_style"),
        text["link"].alias("link"),
        (published if published is not None else F.lit("")).alias("published"),
        *([F.col("pos")] if "pos" in raw.columns else []),
    )


def integer_ids(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null ids become 0 and negative ids are raised to 0."""
    present = [c for c in (columns or ID_COLUMNS) if c in df.columns]
    return df.withColumns(
        {c: F.greatest(F.coalesce(F.col(c).cast("string").try_cast("double").cast("bigint"), F.lit(0)), F.lit(0)) for c in present}
    )


def factorize(df: DataFrame, key: str, name: str, pos: str = "pos", source: DataFrame | None = None) -> DataFrame:
    """Dense 0-based code of ``key`` by first appearance; null keys get 0.

    ``source`` holds the rows to take the order from when ``df`` is a derivation of it.
    """
    first = (source or df).where(F.col(key).isNotNull()).groupBy(key).agg(F.min(pos).alias("_first"))
    codes = global_position(first, ["_first"], F.floor(F.col("_first") / CHUNK_ROWS), name).drop("_first")
    return df.join(codes, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def topic_frequency(df: DataFrame, key: str = "topic_name", name: str = "frequency") -> DataFrame:
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key)


def popularity(df: DataFrame, key: str = "topic_name", name: str = "popularity_bucket", pos: str = "pos") -> DataFrame:
    """Quartile of the topic's traffic; rows of equal traffic are ranked in row order."""
    counted = topic_frequency(df, key, "_freq")
    chunk = F.struct("_freq", F.floor(F.col(pos) / CHUNK_ROWS))
    ranked = global_position(counted, ["_freq", pos], chunk, "_rank")
    rows = df.agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn(name, N.quartile_bucket(F.col("_rank") + 1, rows)).drop("_freq", "_rank")


def stable_hash(text: Column, buckets: Column | int) -> Column:
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def topic_clusters(df: DataFrame, name: str = "topic_cluster_id") -> DataFrame:
    """Stable hash bucket of the headline; one bucket per twenty rows, between 8 and 64."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    buckets = F.greatest(F.lit(8), F.least(F.lit(64), F.floor(rows / 20)))
    return df.withColumn(name, stable_hash(F.lower(T.text_or_empty(F.col("headline"))), buckets))


def fallback_cluster(headline: Column) -> Column:
    """Cluster id of inventories without one: hash of the first word in 32 buckets."""
    return stable_hash(F.split_part(T.text_or_empty(headline), F.lit(" "), F.lit(1)), 32)


def row_ids(df: DataFrame, pos: str = "pos", name: str = "item_id") -> DataFrame:
    return global_position(df, [pos], F.floor(F.col(pos) / CHUNK_ROWS), name)


def build_features(articles: DataFrame, now: Column, entity_rules=None, event_rules=None) -> DataFrame:
    """The full feature table of deduplicated articles (pos, headline, summary, link, emotion, vibe_style, published_utc)."""
    published = F.coalesce(F.col("published_utc"), now)
    style = F.coalesce(F.col("vibe_style"), F.lit(W.DEFAULT_STYLE))
    base = (
        articles.withColumn("topic_name", T.topic_name(F.col("link"), F.col("headline"), F.col("summary")))
        .withColumn("vibe_style", style)
        .withColumn("published_utc", published)
        .withColumn("recency_bucket", N.recency_bucket(N.hours_between(now, published)))
        .withColumn("_text", T.rule_text(F.col("headline"), F.col("summary"), F.col("topic_name")))
        .withColumn("_tokens", T.rule_tokens(F.col("_text")))
        .withColumn("entity_key", T.entity_key(F.col("_text"), F.col("_tokens"), entity_rules))
        .withColumn("event_key", T.event_key(F.col("_text"), F.col("_tokens"), event_rules))
        .drop("_text", "_tokens")
    )
    # Six aggregates read these rows: write them once, and code every dimension from them.
    base = cut_lineage(base)
    out = topic_clusters(base)
    for key, name in (
        ("topic_name", "topic_id"),
        ("vibe_style", "vibe_id"),
        ("entity_key", "entity_id"),
        ("event_key", "event_id"),
    ):
        out = factorize(out, key, name, source=base)
    quartiles = popularity(base.select("pos", "topic_name")).select("pos", "popularity_bucket")
    out = out.join(quartiles, "pos")
    return row_ids(out) if "item_id" not in out.columns else out


def cardinalities(features: DataFrame) -> DataFrame:
    return features.agg(
        F.countDistinct("topic_name").alias("topics"),
        F.countDistinct("vibe_style").alias("vibes"),
        F.countDistinct("topic_cluster_id").alias("clusters"),
        F.countDistinct("entity_key").alias("entities"),
        F.countDistinct("event_key").alias("events"),
    )


def dimension_sizes(features: DataFrame, stored: dict[str, int] | None = None) -> DataFrame:
    """Largest id plus one per id column, never below a stored size."""
    stored = stored or {}
    present = [c for c in ID_COLUMNS if c in features.columns]
    return features.agg(
        *[F.greatest(F.max(c) + 1, F.lit(stored.get(c, 0))).cast("bigint").alias(f"num_{c}") for c in present]
    )


def names_by_id(features: DataFrame, code: str, name: str) -> DataFrame:
    """id -> name dimension; the first name in id order of appearance wins."""
    return features.groupBy(code).agg(F.min_by(name, "pos").alias(name))


def edge_columns(features: DataFrame) -> DataFrame:
    """The inventory in its fixed file column order."""
    by_lower = {c.lower(): c for c in features.columns}
    return features.select(*[F.col(by_lower[c.lower()]).alias(c) for c in W.ARTICLE_COLUMNS])
