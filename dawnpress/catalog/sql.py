"""Shared pieces of the SQL oracles: the canonical tables as common table expressions."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-02-01 00:00:00'"

STYLE_LIST = (
    "['Angry Rant','Dystopian Warning','Hype Beast','Somber Reflection','Clickbait Shocker','Sarcastic Takedown',"
    "'Analytical Deep Dive','Standard Reporting']"
)

ARTICLES = f"""
doc_tidy AS (
  SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS tidy,
         {NOW} - to_minutes((doc_id * 7919) % 43200) AS published_utc
  FROM documents),
articles AS (
  SELECT doc_id AS item_id, doc_id AS pos,
         regexp_extract(tidy, '^(?:[^ ]+ ){{0,11}}[^ ]+') AS headline,
         ltrim(regexp_replace(tidy, '^(?:[^ ]+ ){{0,11}}[^ ]+', '')) AS summary,
         'https://www.' || source || '.example.com/' || lang || '/' || (doc_id % 900) || '?ref=' || doc_id AS link,
         published_utc,
         source || '.example.com' AS topic_name,
         CAST(substr(source, 4) AS INTEGER) AS topic_id,
         {STYLE_LIST}[(doc_id % 8) + 1] AS vibe_style,
         CAST(doc_id % 8 AS INTEGER) AS vibe_id,
         CAST(doc_id % 64 AS INTEGER) AS topic_cluster_id,
         'Entity Group ' || (doc_id % 19) AS entity_key,
         'event_' || (doc_id % 13) AS event_key,
         CASE WHEN epoch_us({NOW}) - epoch_us(published_utc) <= 3600000000 THEN 0
              WHEN epoch_us({NOW}) - epoch_us(published_utc) <= 21600000000 THEN 1
              WHEN epoch_us({NOW}) - epoch_us(published_utc) <= 86400000000 THEN 2
              WHEN epoch_us({NOW}) - epoch_us(published_utc) <= 259200000000 THEN 3 ELSE 4 END AS recency_bucket,
         CAST(doc_id % 4 AS INTEGER) AS popularity_bucket
  FROM doc_tidy)"""

INTERACTION_EVENTS = """
interaction_events AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, 'seg' || (user_id % 4) AS user_type,
         CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS condition,
         ts, least(10.0::DOUBLE, value / 10) AS dwell,
         CASE event_type WHEN 'purchase' THEN 'auto' WHEN 'signup' THEN 'other' ELSE 'skip' END AS reason,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         CASE WHEN event_type = 'purchase' THEN 10.0::DOUBLE
              ELSE -10.0::DOUBLE + greatest(0.0::DOUBLE, least(10.0::DOUBLE, value / 10)) * 2 END AS reward,
         least(10.0::DOUBLE, value / 10) / 10 AS interest
  FROM events)"""

INTERACTIONS = (
    ARTICLES
    + ","
    + INTERACTION_EVENTS
    + """,
interactions AS (
  SELECT e.*, a.item_id, a.topic_id, a.topic_name, a.vibe_id, a.vibe_style, a.topic_cluster_id, a.headline,
         a.recency_bucket
  FROM interaction_events e
  JOIN articles a ON a.item_id = (e.event_id * 31) % (SELECT count(*) FROM documents))"""
)

PROFILES = """
profiles AS (
  SELECT CAST(c_custkey AS VARCHAR) AS uid, CAST(c_custkey % 3 AS INTEGER) AS collection, c_custkey,
         c_mktsegment AS seg, n_name AS nat
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def words(values) -> str:
    """SQL list literal of strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def with_tables(body: str, *tables: str) -> str:
    return "WITH " + ",".join(tables) + body
