"""Demand queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnpress.catalog.base import query
from dawnpress.catalog.sql import INTERACTIONS, with_tables, words
from dawnpress.functions import wordlists as W
from dawnpress.operators import demand as D
from dawnpress.sources import fixtures as X

R6 = lambda name: F.round(name, 6).alias(name)


@query(
    "domain_demand",
    with_tables(
        """
SELECT topic_name, count(*) AS interactions, round(avg(reward), 6) AS avg_reward,
       round(avg(reward) * sqrt(count(*)), 6) AS score
FROM interactions GROUP BY topic_name HAVING count(*) >= 6 ORDER BY score DESC, topic_name LIMIT 12""",
        INTERACTIONS,
    ),
)
def _domain_demand(spark, sf):
    return D.domain_demand(X.interactions(spark, sf)).select("topic_name", "interactions", R6("avg_reward"), R6("score"))


@query(
    "typed_interactions",
    """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS micros,
       CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE round(value, 6) END AS reward,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value / 2, 6) END AS regret,
       'src' || (event_id % 20) || '.example.com' AS topic_name, '' AS headline, 'unknown' AS user_type
FROM events""",
)
def _typed_interactions(spark, sf):
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id")
    raw = X.table(spark, sf, "events").select(
        "event_id",
        F.when(i % 4 == 3, F.lit("yesterday")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp_utc"),
        F.when(i % 5 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("reward"),
        F.when(i % 3 == 0, F.lit("")).otherwise((F.col("value") / 2).cast("string")).alias("regret"),
        F.concat(F.lit(" HTTPS://WWW.src"), (i % 20).cast("string"), F.lit(".example.com/a/b")).alias("topic_name"),
    )
    return D.typed_interactions(raw).select(
        "event_id",
        F.unix_micros("timestamp_utc").alias("micros"),
        R6("reward"),
        R6("regret"),
        "topic_name",
        "headline",
        "user_type",
    )


@query(
    "lookback_rows",
    with_tables(
        """
SELECT session_id, count(*) AS recent FROM interaction_events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1
UNION ALL
SELECT 'all of ' || session_id, count(*) FROM interaction_events GROUP BY 1""",
        INTERACTIONS,
    ),
)
def _lookback_rows(spark, sf):
    """Seven days back from the end of the data, and from a date so late that every row is kept."""
    log = X.interaction_events(spark, sf)
    count = lambda df, name: df.groupBy(name.alias("session_id")).agg(F.count(F.lit(1)).alias("recent"))
    near = D.recent_or_all(log, X.now(), 7)
    late = D.recent_or_all(log, F.lit("2030-01-01 00:00:00").cast("timestamp"), 7)
    return count(near, F.col("session_id")).unionByName(count(late, F.concat(F.lit("all of "), "session_id")))


SQL_STARVED = "SELECT user_type FROM interactions GROUP BY user_type HAVING count(*) >= 20 AND avg(reward) < 2.5"


@query(
    "starved_cohorts",
    with_tables(
        """
SELECT user_type, count(*) AS interactions, round(avg(reward), 6) AS avg_reward
FROM interactions GROUP BY user_type HAVING count(*) >= 20 AND avg(reward) < 2.5""",
        INTERACTIONS,
    ),
)
def _starved(spark, sf):
    return D.starved_cohorts(X.interactions(spark, sf)).select("user_type", "interactions", R6("avg_reward"))


@query(
    "cohort_summary",
    with_tables(
        """
SELECT user_type, count(*) AS interactions, round(avg(reward), 6) AS avg_reward,
       round(coalesce(avg(CASE WHEN user_type <> 'seg3' THEN 10 - reward END), 0.0::DOUBLE), 6) AS avg_regret
FROM interaction_events GROUP BY user_type""",
        INTERACTIONS,
    ),
)
def _cohort_summary(spark, sf):
    log = X.interaction_events(spark, sf).withColumn(
        "regret", F.when(F.col("user_type") != "seg3", F.lit(10.0) - F.col("reward"))
    )
    return D.cohort_summary(log).select("user_type", "interactions", R6("avg_reward"), R6("avg_regret"))


def sql_terms(table: str, keep: str) -> str:
    from dawnpress.catalog.text import sql_demand_tokens

    pairs = "list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i+1])"
    return (
        f"SELECT {keep} unnest(list_distinct(list_concat(k, {pairs}))) AS term FROM "
        f"(SELECT {keep} {sql_demand_tokens('headline')} AS k FROM {table})"
    )


TERM_DEMAND = f"""
inv AS (SELECT term, count(*) AS inventory FROM ({sql_terms('articles', '')}) GROUP BY term),
hit_rows AS (SELECT * FROM interactions WHERE reward >= 7.0),
starved AS ({SQL_STARVED}),
hits AS (SELECT term, count(*) AS hits, count(*) FILTER (WHERE user_type IN (SELECT user_type FROM starved)) AS starved_hits
         FROM ({sql_terms('hit_rows', 'user_type,')}) GROUP BY term HAVING count(*) >= 2),
demand AS (SELECT term, hits, starved_hits, coalesce(inventory, 0) AS inventory,
    hits * (1.0::DOUBLE / (1 + sqrt(coalesce(inventory, 0)))) * (1 + least(2.0::DOUBLE, starved_hits / 5.0::DOUBLE)) AS score
  FROM hits LEFT JOIN inv USING (term))"""


@query(
    "term_demand",
    with_tables(
        " SELECT term, hits::BIGINT AS hits, starved_hits::BIGINT AS starved_hits, inventory, round(score, 6) AS score FROM demand",
        INTERACTIONS,
        TERM_DEMAND,
    ),
)
def _term_demand(spark, sf):
    terms = D.term_demand(X.interactions(spark, sf), X.articles(spark, sf))
    return terms.select("term", "hits", "starved_hits", "inventory", R6("score"))


@query(
    "inventory_terms",
    with_tables(f" SELECT term, count(*) AS inventory FROM ({sql_terms('articles', '')}) GROUP BY term", INTERACTIONS),
)
def _inventory_terms(spark, sf):
    return D.inventory_terms(X.articles(spark, sf))


def feed_map(spark, sf):
    """Feed URLs of the sources with an even number; the others have none."""
    return (
        X.table(spark, sf, "documents")
        .where(F.substring("source", 4, 10).cast("int") % 2 == 0)
        .select(F.concat("source", F.lit(".example.com")).alias("topic_name"))
        .distinct()
        .withColumn("feed_url", F.concat(F.lit("https://"), "topic_name", F.lit("/rss.xml")))
    )


TOP_DOMAINS = """
top_domains AS (SELECT topic_name, avg(reward) * sqrt(count(*)) AS score FROM interactions GROUP BY topic_name
                HAVING count(*) >= 6 ORDER BY score DESC, topic_name LIMIT 12),
feeds AS (SELECT DISTINCT source || '.example.com' AS topic_name, 'https://' || source || '.example.com/rss.xml' AS feed_url
          FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 2 = 0)"""


@query(
    "preferred_feeds",
    with_tables(" SELECT topic_name, feed_url FROM top_domains JOIN feeds USING (topic_name)", INTERACTIONS, TOP_DOMAINS),
)
def _preferred_feeds(spark, sf):
    domains = D.domain_demand(X.interactions(spark, sf))
    return D.known_feeds(domains, feed_map(spark, sf)).select("topic_name", "feed_url")


@query(
    "wishlist",
    with_tables(
        """,
users AS (SELECT string_agg(user_type || '=' || n || ':' || CAST(r AS VARCHAR), ',' ORDER BY user_type) AS users
          FROM (SELECT user_type, count(*) AS n, CAST(round(avg(reward) * 1000) AS BIGINT) AS r FROM interactions
                WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY user_type))
SELECT (SELECT count(*) FROM events) AS interaction_rows_total, (SELECT count(*) FROM events) AS interaction_rows_analyzed,
  (SELECT string_agg(term, ',' ORDER BY score DESC, term) FROM (SELECT * FROM demand ORDER BY score DESC, term LIMIT 24)) AS queries,
  (SELECT string_agg(topic_name, ',' ORDER BY score DESC, topic_name) FROM top_domains) AS preferred_domains,
  (SELECT string_agg(feed_url, ',' ORDER BY score DESC, topic_name) FROM top_domains JOIN feeds USING (topic_name)) AS extra_feed_urls,
  users FROM users""",
        INTERACTIONS,
        TERM_DEMAND,
        TOP_DOMAINS,
    ),
)
def _wishlist(spark, sf):
    log = X.interactions(spark, sf).withColumn("regret", F.lit(None).cast("double"))
    analysed = D.recent_or_all(log, X.now(), 31)
    doc = D.wishlist(log, analysed, X.articles(spark, sf), feed_map(spark, sf))
    user = lambda u: F.concat(
        u["user_type"], F.lit("="), u["interactions"].cast("string"), F.lit(":"),
        F.round(u["avg_reward"] * 1000).cast("bigint").cast("string"),
    )
    return doc.select(
        "interaction_rows_total",
        "interaction_rows_analyzed",
        *[F.array_join(c, ",").alias(c) for c in ("queries", "preferred_domains", "extra_feed_urls")],
        F.array_join(F.transform("user_summary", user), ",").alias("users"),
    )


@query(
    "weekly_domain_demand",
    with_tables(
        """,
w AS (SELECT topic_name, reward, unnest(range(0, 7)) AS back, date_trunc('day', ts) AS day FROM interactions)
SELECT strftime(day - to_days(CAST(back AS INTEGER)), '%Y-%m-%d') AS window_start, topic_name, count(*) AS interactions,
       round(avg(reward) * sqrt(count(*)), 6) AS score
FROM w GROUP BY 1, 2 HAVING count(*) >= 6""",
        INTERACTIONS,
    ),
)
def _weekly_domain_demand(spark, sf):
    from dawnpress.streaming.demand import windowed_demand

    return windowed_demand(X.interactions(spark, sf)).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "topic_name", "interactions", R6("score")
    )
