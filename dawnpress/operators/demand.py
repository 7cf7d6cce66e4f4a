"""Demand analytics over the interaction log: which sources and terms do readers reward?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnpress.functions import text as T


def typed_interactions(raw: DataFrame) -> DataFrame:
    """Lenient typing of a landed log: unreadable times are null, rewards 0, missing columns get their default."""
    have = set(raw.columns)
    out = raw
    for name, default in (("topic_name", ""), ("headline", ""), ("user_type", "unknown")):
        if name not in have:
            out = out.withColumn(name, F.lit(default))
    if "timestamp_utc" in have:
        out = out.withColumn("timestamp_utc", T.lenient_timestamp(F.col("timestamp_utc")))
    for name, fill in (("reward", 0.0), ("regret", None)):
        if name in have:
            number = F.col(name).cast("string").try_cast("double")
            out = out.withColumn(name, F.coalesce(number, F.lit(fill)) if fill is not None else number)
    return out.withColumn("topic_name", T.normalize_domain(F.col("topic_name")))


def recent_or_all(log: DataFrame, now: Column, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last ``days`` days, or every row when there are none."""
    cutoff = now - F.expr(f"interval {max(1, days)} days")
    any_recent = log.where(F.col(ts) >= cutoff).agg(F.count(F.lit(1)) > 0).scalar()
    return log.where((F.col(ts) >= cutoff) | ~any_recent)


def domain_demand(log: DataFrame, min_rows: int = 6, top: int | None = 12) -> DataFrame:
    """Sources by mean reward times the root of their traffic; equal scores in name order."""
    scored = (
        log.where(F.col("topic_name") != "")
        .groupBy("topic_name")
        .agg(F.count(F.lit(1)).alias("interactions"), F.avg("reward").alias("avg_reward"))
        .where(F.col("interactions") >= min_rows)
        .withColumn("score", F.col("avg_reward") * F.sqrt("interactions"))
    )
    return scored if top is None else scored.orderBy(F.desc("score"), "topic_name").limit(top)


def starved_cohorts(log: DataFrame, min_rows: int = 20, below: float = 2.5) -> DataFrame:
    stats = log.groupBy("user_type").agg(F.count(F.lit(1)).alias("interactions"), F.avg("reward").alias("avg_reward"))
    return stats.where((F.col("interactions") >= min_rows) & (F.col("avg_reward") < below))


def cohort_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("user_type").agg(
        F.count(F.lit(1)).alias("interactions"),
        F.avg("reward").alias("avg_reward"),
        F.coalesce(F.avg("regret"), F.lit(0.0)).alias("avg_regret"),
    )


def headline_terms(df: DataFrame, *keep: str) -> DataFrame:
    """One row per distinct term of each headline."""
    tokens = df.select(*keep, T.demand_tokens(F.col("headline")).alias("_tokens"))
    return tokens.select(*keep, F.explode(T.demand_terms(F.col("_tokens"))).alias("term"))


def inventory_terms(inventory: DataFrame) -> DataFrame:
    return headline_terms(inventory).groupBy("term").agg(F.count(F.lit(1)).alias("inventory"))


def rewarded_rows(log: DataFrame, threshold: float = 7.0) -> DataFrame:
    """Rows at or above the threshold, or every positive row when none reaches it."""
    any_hit = log.where(F.col("reward") >= threshold).agg(F.count(F.lit(1)) > 0).scalar()
    return log.where((F.col("reward") >= threshold) | (~any_hit & (F.col("reward") > 0)))


def term_demand(
    log: DataFrame, inventory: DataFrame, threshold: float = 7.0, min_hits: int = 2, top: int | None = None
) -> DataFrame:
    """Terms of rewarded headlines, scarce ones and those of unhappy cohorts first.

    Interactions repeat few headlines, so rows are first counted per (headline, cohort); terms are only exploded from
    those counts. The cohort table is a handful of rows after aggregation and AQE decides how to join it.
    """
    starved = starved_cohorts(log).select("user_type", F.lit(1).alias("_starved"))
    per_headline = rewarded_rows(log, threshold).groupBy("headline", "user_type").agg(F.count(F.lit(1)).alias("_n"))
    hits = (
        headline_terms(per_headline, "user_type", "_n")
        .join(starved, "user_type", "left")
        .groupBy("term")
        .agg(
            F.sum("_n").alias("hits"),
            F.coalesce(F.sum(F.when(F.col("_starved") == 1, F.col("_n"))), F.lit(0)).alias("starved_hits"),
        )
        .where(F.col("hits") >= min_hits)
    )
    counted = hits.join(inventory_terms(inventory), "term", "left").fillna(0, ["inventory"])
    scarcity = F.lit(1.0) / (F.sqrt("inventory") + 1.0)
    bonus = F.least(F.lit(2.0), F.col("starved_hits") / 5.0) + 1.0
    scored = counted.withColumn("score", F.col("hits") * scarcity * bonus)
    return scored if top is None else scored.orderBy(F.desc("score"), "term").limit(top)


def known_feeds(domains: DataFrame, feeds: DataFrame) -> DataFrame:
    """Feed URL of each preferred domain that has one; ``feeds`` is (topic_name, feed_url)."""
    return domains.join(feeds, "topic_name")


def wishlist(
    log: DataFrame,
    analysed: DataFrame,
    inventory: DataFrame,
    feeds: DataFrame,
    max_queries: int = 24,
    max_domains: int = 12,
) -> DataFrame:
    """One row: query terms, preferred domains and their feeds in order, cohort summary, row counts.

    Only top-k reports are folded into arrays, so every list is bounded by its parameter; the cohort map is bounded by
    the number of cohorts.
    """

    def ranked(field: str, *cols: Column | str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct(*cols))), lambda x: x[field])

    domains = domain_demand(analysed, top=max_domains)
    terms = term_demand(analysed, inventory, top=max_queries)
    urls = known_feeds(domains, feeds)
    best_first = (-F.col("score")).alias("s")
    names = domains.agg(ranked("topic_name", best_first, "topic_name"))
    queries = terms.agg(ranked("term", best_first, "term"))
    extra = urls.agg(F.array_distinct(ranked("feed_url", best_first, "topic_name", "feed_url")))
    cohorts = cohort_summary(analysed).agg(
        F.sort_array(F.collect_list(F.struct("user_type", "interactions", "avg_reward", "avg_regret"))).alias("users")
    )
    return (
        log.agg(F.count(F.lit(1)).alias("interaction_rows_total"))
        .withColumn("interaction_rows_analyzed", analysed.agg(F.count(F.lit(1))).scalar())
        .withColumn("queries", queries.scalar())
        .withColumn("preferred_domains", names.scalar())
        .withColumn("extra_feed_urls", extra.scalar())
        .withColumn("user_summary", cohorts.scalar())
    )
