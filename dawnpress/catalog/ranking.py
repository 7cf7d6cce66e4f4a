"""Retrieval and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnpress.catalog.base import query
from dawnpress.catalog.sql import INTERACTIONS, with_tables
from dawnpress.catalog.windows import LATEST, head_logits, sql_head_score
from dawnpress.functions import numeric as N
from dawnpress.functions import profiles as P
from dawnpress.functions import wordlists as W
from dawnpress.operators import evaluation as E
from dawnpress.operators import ranking as R
from dawnpress.operators import retrieval as Q
from dawnpress.operators import windows as O
from dawnpress.sources import fixtures as X

C = F.col
R6 = lambda name: F.round(name, 6).alias(name)

VECTORS = """
vecs AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
last5 AS (SELECT session_id, (SELECT vec FROM vecs WHERE vec_id = item_id % (SELECT count(*) FROM embeddings)) AS vec FROM latest WHERE seen_rank <= 5),
dims AS (SELECT session_id, d, avg(vec[d]) AS m FROM last5, (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL),
users AS (SELECT session_id, list(m ORDER BY d) AS vec FROM dims GROUP BY session_id)"""


def article_vectors(spark, sf):
    """Articles with the vector of embedding ``item_id`` modulo the number of embeddings."""
    vectors = X.item_vectors(spark, sf).select(C("item_id").alias("vec_id"), "vec")
    n = X.table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    return X.articles(spark, sf).withColumn("vec_id", C("item_id") % n).join(vectors, "vec_id").drop("vec_id")


def user_vectors(spark, sf, seen=None):
    """Mean vector of each session's last five items."""
    seen = O.latest_seen(X.interactions(spark, sf)) if seen is None else seen
    n = X.table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    vectors = X.item_vectors(spark, sf).select(C("item_id").alias("vec_id"), "vec")
    last = seen.where("seen_rank <= 5").select("session_id", (C("item_id") % n).alias("vec_id"))
    return R.mean_vector(last.join(vectors, "vec_id"), ["session_id"])


@query(
    "user_vectors",
    with_tables(
        " SELECT session_id, round(list_sum(vec), 6) AS total, round(list_dot_product(vec, vec), 6) AS power FROM users",
        INTERACTIONS,
        LATEST,
        VECTORS,
    ),
)
def _user_vectors(spark, sf):
    add = lambda acc, x: acc + x
    return user_vectors(spark, sf).select(
        "session_id",
        F.round(F.aggregate("vec", F.lit(0.0), add), 6).alias("total"),
        F.round(F.aggregate(F.transform("vec", lambda x: x * x), F.lit(0.0), add), 6).alias("power"),
    )


NEAREST = with_tables(
    """,
s AS (SELECT session_id, vec_id AS item_id, round(list_dot_product(u.vec, v.vec), 9) AS score FROM users u, vecs v),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY score DESC, item_id) AS INTEGER) AS near_rank FROM s)
SELECT session_id, item_id, near_rank, round(score, 6) AS score FROM r WHERE near_rank <= 20""",
    INTERACTIONS,
    LATEST,
    VECTORS,
)


@query("nearest_items", NEAREST)
def _nearest_items(spark, sf):
    near = Q.top_n_exact(user_vectors(spark, sf), X.item_vectors(spark, sf), 20)
    return near.select("session_id", "item_id", "near_rank", R6("score"))


@query("nearest_items_by_bounds", NEAREST)
def _nearest_items_by_bounds(spark, sf):
    near = Q.top_n_by_bounds(user_vectors(spark, sf), X.item_vectors(spark, sf), 20)
    return near.select("session_id", "item_id", "near_rank", R6("score"))


@query("search_effort")
def _search_effort(spark, sf):
    """Items that the search of ``nearest_items_by_bounds`` scores per session, of all items."""
    return Q.search_by_bounds(user_vectors(spark, sf), X.item_vectors(spark, sf), 20)[1]


BLOCKED = """
uni AS (SELECT count(*) AS total FROM documents),
inside AS (SELECT DISTINCT session_id, item_id FROM latest),
strict AS (SELECT session_id, count(*) AS seen FROM inside GROUP BY 1 HAVING (SELECT total FROM uni) - count(*) >= 20),
blocked AS (SELECT i.* FROM inside i JOIN strict USING (session_id)),
sizes AS (SELECT session_id, (SELECT total FROM uni) - coalesce(seen, 0) AS available FROM (SELECT DISTINCT session_id FROM inside) LEFT JOIN strict USING (session_id))"""


@query(
    "available_items",
    with_tables(
        """ SELECT session_id, available, (SELECT count(*) FROM blocked b WHERE b.session_id = s.session_id) AS left_out FROM sizes s""",
        INTERACTIONS,
        LATEST,
        BLOCKED,
    ),
)
def _available(spark, sf):
    seen = O.latest_seen(X.interactions(spark, sf))
    sessions = seen.select("session_id").distinct()
    sizes, blocked = Q.available_items(sessions, seen, X.articles(spark, sf), 20)
    left = blocked.groupBy("session_id").agg(F.count(F.lit(1)).alias("left_out"))
    return sizes.join(left, "session_id", "left").fillna(0, ["left_out"])


@query(
    "preferred_universe",
    with_tables(
        " SELECT item_id FROM articles WHERE topic_name NOT IN ('src3.example.com', 'src8.example.com')",
        INTERACTIONS,
    ),
)
def _preferred_universe(spark, sf):
    low = ["src3.example.com", "src8.example.com"]
    return Q.preferred_universe(X.articles(spark, sf), low).select("item_id")


@query(
    "unseen_pick",
    with_tables(
        """,
ring AS (SELECT doc_id AS item_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place FROM documents),
st AS (SELECT session_id, CAST(floor(('0x' || substr(md5(session_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (SELECT total FROM uni)) AS BIGINT) AS start FROM sizes),
w AS (SELECT session_id, item_id, (place - start + (SELECT total FROM uni)) % (SELECT total FROM uni) AS slot FROM st, ring
      WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.session_id = st.session_id AND i.item_id = ring.item_id))
SELECT session_id, arg_min(item_id, slot) AS item_id FROM w GROUP BY session_id""",
        INTERACTIONS,
        LATEST,
        BLOCKED,
    ),
)
def _unseen_pick(spark, sf):
    seen = O.latest_seen(X.interactions(spark, sf))
    return R.unseen_pick(seen.select("session_id").distinct(), seen, X.articles(spark, sf))


RECALL = """
ring AS (SELECT doc_id AS item_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place FROM documents),
st AS (SELECT session_id, CAST(floor(('0x' || substr(md5(session_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (SELECT total FROM uni)) AS BIGINT) AS start FROM sizes),
near AS (SELECT session_id, item_id, row_number() OVER (PARTITION BY session_id ORDER BY round(list_dot_product(u.vec, v.vec), 9) DESC, item_id) AS slot
         FROM users u, articles a JOIN vecs v ON v.vec_id = a.item_id % (SELECT count(*) FROM embeddings)),
offers AS (
  SELECT session_id, 0 AS channel, (place - start + (SELECT total FROM uni)) % (SELECT total FROM uni) AS slot, item_id FROM st, ring
  UNION ALL SELECT session_id, 1, slot, item_id FROM near
  UNION ALL SELECT session_id, 2, row_number() OVER (PARTITION BY session_id ORDER BY popularity_bucket DESC, item_id), item_id FROM st, articles
  UNION ALL SELECT session_id, 3, row_number() OVER (PARTITION BY session_id ORDER BY recency_bucket, item_id), item_id FROM st, articles
  UNION ALL SELECT session_id, 4, item_id, item_id FROM st, articles),
allowed AS (SELECT o.*, available, least(260, available) AS target FROM offers o JOIN sizes USING (session_id)
  WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.session_id = o.session_id AND b.item_id = o.item_id)),
quotas AS (SELECT *, greatest(1, CAST(floor(target * 0.35::DOUBLE) AS BIGINT)) AS q0, greatest(1, CAST(floor(target * 0.15::DOUBLE) AS BIGINT)) AS q2 FROM allowed),
nth AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel ORDER BY slot) AS n FROM quotas),
fit AS (SELECT * FROM nth WHERE n <= CASE channel WHEN 0 THEN q0 WHEN 1 THEN q0 WHEN 2 THEN q2 WHEN 3 THEN greatest(1, target - 2 * q0 - q2) ELSE 1000000000 END),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, item_id ORDER BY channel, n) AS o FROM fit) WHERE o = 1),
recalled AS (SELECT * FROM (SELECT session_id, item_id, channel, target, CAST(row_number() OVER (PARTITION BY session_id ORDER BY channel, n) AS INTEGER) AS recall_rank FROM once) WHERE recall_rank <= target)"""


def recall_inputs(spark, sf):
    from dawnpress.session import cut_lineage

    log = X.interactions(spark, sf).select("session_id", "step", "item_id", "topic_id", "topic_cluster_id")
    seen = cut_lineage(O.latest_seen(log))
    universe = cut_lineage(article_vectors(spark, sf).select("item_id", "vec", "popularity_bucket", "recency_bucket"))
    return cut_lineage(user_vectors(spark, sf, seen)), seen, universe


@query(
    "recall",
    with_tables(
        " SELECT session_id, item_id, channel, recall_rank FROM recalled", INTERACTIONS, LATEST, VECTORS, BLOCKED, RECALL
    ),
)
def _recall(spark, sf):
    return Q.recall(*recall_inputs(spark, sf))


PRE_RANK = f"""
recent_topics AS (SELECT session_id, topic_id, count(*) AS n FROM latest GROUP BY ALL),
recent_clusters AS (SELECT session_id, topic_cluster_id, count(*) AS n FROM latest GROUP BY ALL),
streaks AS (SELECT session_id, min(topic_id) AS topic_id FROM latest WHERE seen_rank <= 5 GROUP BY 1 HAVING count(*) = 5 AND min(topic_id) = max(topic_id)),
bad AS (SELECT session_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, topic_id ORDER BY step DESC) AS rn FROM interactions) WHERE rn <= 12
        GROUP BY 1, 2 HAVING count(*) >= 4 AND avg(reward) <= -3),
cand AS (SELECT r.session_id, r.item_id, a.topic_id, a.topic_cluster_id, a.recency_bucket, {sql_head_score(W.SERVING_WEIGHTS).replace('item_id', 'r.item_id').replace('session_id', 'r.session_id')} AS base_score
         FROM recalled r JOIN articles a ON a.item_id = r.item_id)"""


@query(
    "pre_rank",
    with_tables(
        """,
sc AS (SELECT c.*, coalesce(t.n, 0) AS tn, coalesce(k.n, 0) AS cn, s.topic_id IS NOT NULL AS st, b.topic_id IS NOT NULL AS bd FROM cand c
  LEFT JOIN recent_topics t ON t.session_id = c.session_id AND t.topic_id = c.topic_id
  LEFT JOIN recent_clusters k ON k.session_id = c.session_id AND k.topic_cluster_id = c.topic_cluster_id
  LEFT JOIN streaks s ON s.session_id = c.session_id AND s.topic_id = c.topic_id
  LEFT JOIN bad b ON b.session_id = c.session_id AND b.topic_id = c.topic_id),
v AS (SELECT 'serving' AS rules, session_id, item_id, (base_score + CASE WHEN tn = 0 THEN 0.10 ELSE 0 END + CASE WHEN cn = 0 THEN 0.06 ELSE 0 END
     + 0.08 * greatest(0, 4 - recency_bucket) / 4 - 0.08 * tn) * CASE WHEN st THEN 0.35 ELSE 1 END AS score, 96 AS size FROM sc
  UNION ALL SELECT 'training', session_id, item_id, (base_score + CASE WHEN tn = 0 THEN 0.10 ELSE 0 END + CASE WHEN cn = 0 THEN 0.05 ELSE 0 END
     + 0.08 * greatest(0, 4 - recency_bucket) / 4 - 0.07 * tn) * CASE WHEN bd THEN 0.10 ELSE 1 END * CASE WHEN st THEN 0.20 ELSE 1 END, 200 FROM sc),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rules, session_id ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS pre_rank FROM v)
SELECT rules, session_id, item_id, pre_rank, round(score, 6) AS score FROM r WHERE pre_rank <= size""",
        INTERACTIONS,
        LATEST,
        VECTORS,
        BLOCKED,
        RECALL,
        PRE_RANK,
    ),
)
def _pre_rank(spark, sf):
    from dawnpress.session import cut_lineage

    users, seen, universe = recall_inputs(spark, sf)
    bad = O.bad_domains(X.interactions(spark, sf))
    features = X.articles(spark, sf).select("item_id", "topic_id", "topic_name", "topic_cluster_id", "recency_bucket")
    recalled = Q.recall(users, seen, universe).select("session_id", "item_id")
    cand = cut_lineage(recalled.join(features, "item_id").withColumn("base_score", N.head_score(head_logits())))
    topics, clusters, streaks = O.exposure(seen, "topic_id"), O.exposure(seen, "topic_cluster_id"), O.streak_topic(seen)
    serving = R.pre_rank(cand, topics, clusters, streaks).withColumn("rules", F.lit("serving"))
    training = R.pre_rank(cand, topics, clusters, streaks, bad, R.TRAINING).withColumn("rules", F.lit("training"))
    cols = ["rules", "session_id", "item_id", "pre_rank", R6("score")]
    return serving.select(cols).unionByName(training.select(cols))


SEEDS = """
seeds AS (SELECT DISTINCT session_id, CASE CAST(session_id AS BIGINT) % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'by train' WHEN 2 THEN '' ELSE 'bus' END AS commute,
  [CASE WHEN CAST(session_id AS BIGINT) % 2 = 0 THEN 'the of' ELSE 'de la' END, 'and  eaux'] AS interests FROM latest),
lexicon AS (SELECT session_id, commute, list_transform(interests, lambda s: replace(s, '  ', ' ')) AS phrases,
  list_filter(list_distinct(flatten(list_transform(interests, lambda s: string_split(replace(s, '  ', ' '), ' ')))), lambda t: length(t) >= 3 AND t NOT IN ('and', 'the')) AS tokens FROM seeds),
hay AS (SELECT l.session_id, l.item_id, l.seen_rank, l.recency_bucket, a.vibe_style, a.summary, lower(trim(a.headline || ' ' || a.summary || CASE WHEN a.summary = '' THEN '' ELSE ' ' END || a.topic_name || ' ' || a.vibe_style)) AS hay
        FROM latest l JOIN articles a USING (item_id)),
bonus AS (SELECT h.*, commute, 0.30 * least(1.0::DOUBLE, 0.22 * len(list_intersect(list_distinct(regexp_extract_all(hay, '[a-z0-9]+')), tokens))
    + 0.45 * least(3, len(list_filter(phrases, lambda p: contains(hay, p))))) AS interest,
    greatest(0, 4 - recency_bucket) / 4.0::DOUBLE AS freshness,
    greatest(least(1.0::DOUBLE, CASE WHEN summary = '' THEN 0 ELSE len(string_split(summary, ' ')) END / 55.0::DOUBLE), CASE WHEN regexp_matches(lower(vibe_style), 'analytical|deep') THEN 0.8 ELSE 0 END) AS depth
  FROM hay h JOIN lexicon USING (session_id)),
seeded AS (SELECT *, interest + CASE commute WHEN '' THEN 0 WHEN 'short' THEN 0.08 * freshness WHEN 'by train' THEN 0.08 * depth ELSE 0.08 * (freshness + depth) / 2 END
   + 1.0 / seen_rank AS score FROM bonus)"""


def seeds(spark, sf, sessions):
    number = C("session_id").cast("bigint")
    commute = F.when(number % 4 == 0, "short").when(number % 4 == 1, "by train").when(number % 4 == 2, "").otherwise("bus")
    interests = F.array(F.when(number % 2 == 0, "the of").otherwise("de la"), F.lit("and  eaux"))
    phrases = P.interest_phrases(interests)
    return sessions.select(
        "session_id", commute.alias("commute"), phrases.alias("phrases"), P.interest_tokens(phrases).alias("tokens")
    )


@query(
    "seed_rerank",
    with_tables(
        """ SELECT session_id, item_id, round(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, seen_rank) AS INTEGER) AS pre_rank FROM seeded""",
        INTERACTIONS,
        LATEST,
        SEEDS,
    ),
)
def _seed_rerank(spark, sf):
    """The session's latest items, reordered by its interests and commute."""
    seen = O.latest_seen(X.interactions(spark, sf))
    texts = R.item_texts(X.articles(spark, sf))
    ranked = seen.select("session_id", "item_id", C("seen_rank").alias("pre_rank"), (F.lit(1.0) / C("seen_rank")).alias("score"))
    out = R.seed_rerank(ranked, seeds(spark, sf, seen.select("session_id").distinct()), texts)
    return out.select("session_id", "item_id", R6("score"), "pre_rank")


def _feed(spark, sf, k):
    from dawnpress.plans.feed import cascade
    from dawnpress.session import cut_lineage

    log = X.interactions(spark, sf)
    users, seen, universe = recall_inputs(spark, sf)
    steps = log.groupBy("session_id").agg(F.max("step").alias("step"))
    sessions = cut_lineage(users.join(steps, "session_id"))
    items = X.articles(spark, sf)
    feed = cascade(sessions, seen, universe, items, head_logits(), seeds(spark, sf, sessions), k)
    return feed.select("session_id", "feed_rank", "id", F.md5("title").alias("title"), "domain", "link")


def sql_seeded(size: int) -> str:
    """Pre-ranked candidates (``size`` a session) with interest and commute bonuses, ranked again."""
    return f"""
fs AS (SELECT c.*, (base_score + CASE WHEN t.n IS NULL THEN 0.10 ELSE 0 END + CASE WHEN k.n IS NULL THEN 0.06 ELSE 0 END + 0.08 * greatest(0, 4 - recency_bucket) / 4
     - 0.08 * coalesce(t.n, 0)) * CASE WHEN s.topic_id IS NOT NULL THEN 0.35 ELSE 1 END AS score FROM cand c
  LEFT JOIN recent_topics t ON t.session_id = c.session_id AND t.topic_id = c.topic_id
  LEFT JOIN recent_clusters k ON k.session_id = c.session_id AND k.topic_cluster_id = c.topic_cluster_id
  LEFT JOIN streaks s ON s.session_id = c.session_id AND s.topic_id = c.topic_id),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, item_id) AS pr FROM fs) WHERE pr <= {size}),
ih AS (SELECT item_id, lower(trim(headline || ' ' || summary || CASE WHEN summary = '' THEN '' ELSE ' ' END || topic_name || ' ' || vibe_style)) AS hay,
  greatest(0, 4 - recency_bucket) / 4.0::DOUBLE AS fresh,
  greatest(least(1.0::DOUBLE, CASE WHEN summary = '' THEN 0 ELSE len(string_split(summary, ' ')) END / 55.0::DOUBLE), CASE WHEN regexp_matches(lower(vibe_style), 'analytical|deep') THEN 0.8 ELSE 0 END) AS deep
  FROM articles),
it AS (SELECT *, list_distinct(regexp_extract_all(hay, '[a-z0-9]+')) AS words FROM ih),
fb AS (SELECT fr.session_id, fr.item_id, fr.pr, fr.score + 0.30 * least(1.0::DOUBLE, 0.22 * len(list_intersect(words, tokens)) + 0.45 * least(3, len(list_filter(phrases, lambda p: contains(hay, p)))))
  + CASE commute WHEN '' THEN 0 WHEN 'short' THEN 0.08 * fresh WHEN 'by train' THEN 0.08 * deep ELSE 0.08 * (fresh + deep) / 2 END AS score
  FROM fr JOIN it USING (item_id) JOIN lexicon USING (session_id)),
ranked AS (SELECT session_id, item_id, score, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, pr) AS pre_rank FROM fb)"""


PRINTS = """
spelt AS (SELECT DISTINCT item_id, unnest(list_filter(string_split(lower(headline || ' ' || summary), ' '), lambda w: w <> '')) AS word FROM articles),
numbered AS (SELECT item_id, CAST(dense_rank() OVER (ORDER BY word) AS INTEGER) AS number FROM spelt),
widths AS (SELECT item_id, count(*) AS n FROM numbered GROUP BY item_id),
shared AS (SELECT a.item_id AS x, b.item_id AS y, count(*) AS c FROM numbered a JOIN numbered b ON a.number = b.number AND a.item_id < b.item_id GROUP BY ALL),
alike AS MATERIALIZED (SELECT x, y, c::DOUBLE / (p.n + q.n - c) AS sim FROM shared JOIN widths p ON p.item_id = x JOIN widths q ON q.item_id = y)"""

# Places count from 1. A step picks the place of the largest value, or looks at the next place of the order.
DIVERSE = """
head AS (SELECT session_id, item_id, score, pre_rank FROM ranked WHERE pre_rank <= 40),
cells AS (SELECT a.session_id, a.pre_rank AS i, b.pre_rank AS j, coalesce(n.sim, 0) AS sim FROM head a JOIN head b ON a.session_id = b.session_id
  LEFT JOIN alike n ON n.x = least(a.item_id, b.item_id) AND n.y = greatest(a.item_id, b.item_id)),
lines AS (SELECT session_id, i, list(sim ORDER BY j) AS line FROM cells GROUP BY ALL),
matrix AS (SELECT session_id, list(line ORDER BY i) AS sims FROM lines GROUP BY session_id),
base AS (SELECT session_id, list(score ORDER BY pre_rank) AS scores, list(item_id ORDER BY pre_rank) AS ids, count(*) AS n FROM head GROUP BY session_id),
mmr AS (
  SELECT session_id, 0 AS step, CAST([] AS BIGINT[]) AS chosen, list_transform(scores, lambda s: 0.0::DOUBLE) AS penalty FROM base
  UNION ALL
  SELECT session_id, step + 1, list_append(chosen, best), list_transform(penalty, lambda p, i: greatest(p, sims[best][i])) FROM (
    SELECT m.session_id, m.step, m.chosen, m.penalty, x.sims,
      list_position(list_transform(b.scores, lambda s, i: CASE WHEN list_contains(m.chosen, i) THEN -1e300 ELSE 0.82 * s - 0.18 * m.penalty[i] END),
        list_max(list_transform(b.scores, lambda s, i: CASE WHEN list_contains(m.chosen, i) THEN -1e300 ELSE 0.82 * s - 0.18 * m.penalty[i] END)))::BIGINT AS best
    FROM mmr m JOIN base b USING (session_id) JOIN matrix x USING (session_id) WHERE m.step < least(20, b.n))),
picked AS (SELECT session_id, arg_max(chosen, step) AS chosen FROM mmr GROUP BY session_id),
steps AS (SELECT session_id, max(step) AS step FROM interactions GROUP BY session_id),
draws AS (SELECT p.session_id, chosen, list_filter(range(1, least(n, 40) + 1), lambda i: NOT list_contains(chosen, i)) AS others, greatest(0.04::DOUBLE, exp(-greatest(step, 0) / 220.0::DOUBLE) * 0.18) AS eps,
  ('0x' || substr(md5(p.session_id || '|' || step || '|gate'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS gate,
  ('0x' || substr(md5(p.session_id || '|' || step || '|place'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS place,
  ('0x' || substr(md5(p.session_id || '|' || step || '|pick'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS pick
  FROM picked p JOIN base USING (session_id) JOIN steps USING (session_id)),
swapped AS (SELECT session_id, CASE WHEN gate < eps AND len(others) > 0 THEN
    list_transform(chosen, lambda c, i: CASE WHEN i = CAST(floor(place * len(chosen)) AS BIGINT) + 1 THEN others[CAST(floor(pick * len(others)) AS BIGINT) + 1] ELSE c END)
  ELSE chosen END AS walk FROM draws),
walks AS (SELECT session_id, list_concat(walk, range(1, n + 1)) AS walk FROM swapped JOIN base USING (session_id)),
spread AS (
  SELECT session_id, 0 AS step, CAST([] AS BIGINT[]) AS kept FROM walks
  UNION ALL
  SELECT s.session_id, s.step + 1, CASE WHEN len(kept) >= 20 OR list_contains(kept, walk[s.step + 1])
      OR len(list_filter(kept, lambda q: sims[walk[s.step + 1]][q] > 0.35)) > 0 THEN kept ELSE list_append(kept, walk[s.step + 1]) END
  FROM spread s JOIN walks USING (session_id) JOIN matrix USING (session_id) WHERE s.step < len(walk)),
final AS (SELECT session_id, arg_max(kept, step) AS kept FROM spread GROUP BY session_id),
fed AS (SELECT session_id, ids[k] AS item_id, place FROM (SELECT session_id, unnest(kept) AS k, unnest(range(1, len(kept) + 1)) AS place FROM final) JOIN base USING (session_id)),
filled AS (SELECT * FROM fed UNION ALL SELECT r.session_id, r.item_id, r.recall_rank + 20 FROM recalled r
  WHERE NOT EXISTS (SELECT 1 FROM fed f WHERE f.session_id = r.session_id AND f.item_id = r.item_id)),
feed AS (SELECT session_id, item_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY place) AS INTEGER) AS feed_rank FROM filled)"""


@query(
    "feed_diverse",
    with_tables(
        """ SELECT session_id, feed_rank, item_id AS id, md5(headline) AS title, topic_name AS domain, link FROM feed JOIN articles USING (item_id) WHERE feed_rank <= 20""",
        INTERACTIONS,
        LATEST,
        VECTORS,
        BLOCKED,
        RECALL,
        PRE_RANK,
        SEEDS,
        sql_seeded(96),
        PRINTS,
        DIVERSE,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _feed_diverse(spark, sf):
    return _feed(spark, sf, None)


RELEVANT = """
listed AS MATERIALIZED (SELECT r.session_id, r.item_id, r.recall_rank, row_number() OVER (PARTITION BY r.session_id ORDER BY k.pre_rank NULLS LAST, r.recall_rank) AS place
  FROM recalled r LEFT JOIN ranked k ON k.session_id = r.session_id AND k.item_id = r.item_id),
core AS MATERIALIZED (SELECT session_id, item_id, place FROM listed WHERE place <= 150),
doubles AS MATERIALIZED (SELECT a.session_id, a.place, list(b.place) AS others FROM core a JOIN core b ON a.session_id = b.session_id AND b.place < a.place
  JOIN alike n ON n.x = least(a.item_id, b.item_id) AND n.y = greatest(a.item_id, b.item_id) AND n.sim > 0.35 GROUP BY ALL),
walk AS (
  SELECT session_id, 0 AS step, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT session_id FROM core)
  UNION ALL
  SELECT w.session_id, w.step + 1, CASE WHEN len(kept) >= 50 OR list_has_any(kept, coalesce(others, [])) THEN kept ELSE list_append(kept, c.place) END
  FROM walk w JOIN core c ON c.session_id = w.session_id AND c.place = w.step + 1 LEFT JOIN doubles d ON d.session_id = w.session_id AND d.place = w.step + 1),
final AS (SELECT session_id, arg_max(kept, step) AS kept FROM walk GROUP BY session_id),
placed AS (SELECT l.session_id, l.item_id, coalesce(list_position(f.kept, l.place), 0) AS seat, l.recall_rank FROM listed l JOIN final f USING (session_id)),
feed AS (SELECT session_id, item_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY (seat = 0), seat, recall_rank) AS INTEGER) AS feed_rank FROM placed)"""


@query(
    "feed_by_relevance",
    with_tables(
        """ SELECT session_id, feed_rank, item_id AS id, md5(headline) AS title, topic_name AS domain, link FROM feed JOIN articles USING (item_id) WHERE feed_rank <= 50""",
        INTERACTIONS,
        LATEST,
        VECTORS,
        BLOCKED,
        RECALL,
        PRE_RANK,
        SEEDS,
        sql_seeded(110),
        PRINTS,
        RELEVANT,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _feed_by_relevance(spark, sf):
    return _feed(spark, sf, 50)


CANDIDATE_LOG = f"""
candidate_log AS (SELECT session_id, step, event_id, k, (event_id * (k + 2)) % (SELECT count(*) FROM documents) * 16 + k AS item_id,
   (('0x' || substr(md5('s' || event_id || '|' || k), 1, 6))::BIGINT % 10000) / 2500.0::DOUBLE - 2 AS score,
   (('0x' || substr(md5('r' || event_id || '|' || k), 1, 6))::BIGINT % 2000) / 100.0::DOUBLE - 10 AS reward,
   (('0x' || substr(md5('p' || event_id || '|' || k), 1, 6))::BIGINT % 3000) / 1000.0::DOUBLE - 1 AS signal
  FROM interaction_events, (SELECT unnest(range(0, 12)) AS k))"""


def candidate_log(spark, sf):
    """Twelve scored alternatives per interaction; number 0 is the one that was shown."""

    def number(tag, modulus):
        digest = F.md5(F.concat(F.lit(tag), C("event_id").cast("string"), F.lit("|"), C("k").cast("string")))
        return F.conv(F.substring(digest, 1, 6), 16, 10).cast("bigint") % modulus

    spread = X.interaction_events(spark, sf).select(
        "session_id", "step", "event_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")
    )
    return spread.select(
        "*",
        (C("event_id") * (C("k") + 2) % X.article_count(spark, sf) * 16 + C("k")).alias("item_id"),
        (number("s", 10000) / 2500.0 - 2).alias("score"),
        (number("r", 2000) / 100.0 - 10).alias("reward"),
        (number("p", 3000) / 1000.0 - 1).alias("signal"),
    )


WINNERS = """
r AS (SELECT *, row_number() OVER w AS r, signal >= 1.15 AS pos FROM candidate_log WINDOW w AS (PARTITION BY session_id, step ORDER BY score DESC, item_id)),
m AS (SELECT *, greatest(2 - sum((r <= 8 AND pos)::INT) OVER d, 0) AS missing, sum((r > 8 AND pos)::INT) OVER (PARTITION BY session_id, step ORDER BY r) AS o,
      sum((r > 8 AND pos)::INT) OVER d > 0 AS any_out FROM r WINDOW d AS (PARTITION BY session_id, step)),
p AS (SELECT *, row_number() OVER (PARTITION BY session_id, step ORDER BY r) AS place, count(*) OVER (PARTITION BY session_id, step) AS n FROM m
      WHERE r <= 8 - CASE WHEN any_out THEN missing ELSE 0 END OR (r > 8 AND pos AND o <= missing)),
d AS (SELECT *, ('0x' || substr(md5(session_id || '|' || step || '|gate'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3 AS exploring,
      ('0x' || substr(md5(session_id || '|' || step || '|pick'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS pick FROM p)"""


@query(
    "greedy_winner",
    with_tables(
        """ SELECT session_id, step, item_id, round(score, 6) AS score, CASE WHEN exploring THEN 'explore' ELSE 'exploit' END AS decision FROM d
WHERE place = CASE WHEN exploring THEN CAST(floor(pick * least(5, n)) AS BIGINT) + 1 ELSE 1 END""",
        INTERACTIONS,
        CANDIDATE_LOG,
        WINNERS,
    ),
)
def _greedy_winner(spark, sf):
    out = R.greedy_winner(candidate_log(spark, sf), C("signal"), F.lit(0.3))
    return out.select("session_id", "step", "item_id", R6("score"), "decision")


@query(
    "counterfactual_regret",
    with_tables(
        """ SELECT session_id, step, round(max(reward) - max(reward) FILTER (WHERE k = 0), 6) AS regret FROM candidate_log GROUP BY 1, 2""",
        INTERACTIONS,
        CANDIDATE_LOG,
    ),
)
def _regret(spark, sf):
    return E.counterfactual_regret(candidate_log(spark, sf), C("k") == 0).select("session_id", "step", R6("regret"))


@query(
    "hard_negatives",
    with_tables(
        """,
c AS (SELECT *, row_number() OVER (PARTITION BY session_id, step ORDER BY score DESC, item_id) AS r, 1 / (1 + exp(-score)) AS conf FROM candidate_log),
b AS (SELECT session_id, step, arg_min(item_id, r) AS item_id, max(conf) AS confidence, arg_min(reward, r) AS reward FROM c WHERE r <= 64 AND k <> 0 AND reward < 0 GROUP BY 1, 2)
SELECT session_id, step, item_id, round(confidence, 6) AS confidence, round(reward, 6) AS reward FROM b WHERE confidence >= 0.60""",
        INTERACTIONS,
        CANDIDATE_LOG,
    ),
)
def _hard_negatives(spark, sf):
    out = E.hard_negatives(candidate_log(spark, sf), C("k") == 0)
    return out.select("session_id", "step", "item_id", R6("confidence"), R6("reward"))


@query(
    "anti_vector_rank",
    """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
a AS (SELECT label, list(m ORDER BY d) AS e FROM (SELECT label, d, avg(e[d]) AS m FROM v, (SELECT unnest(range(1, 65)) AS d) WHERE label IN (0, 1) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id // 4 AS candidate, list_cosine_similarity(e, (SELECT e FROM a WHERE label = 0)) AS p, list_cosine_similarity(e, (SELECT e FROM a WHERE label = 1)) AS n FROM v)
SELECT candidate, round(avg(p), 6) AS positive_mean, round(max(n), 6) AS negative_max, round(avg(p) - 1.2 * max(n), 6) AS score FROM s GROUP BY candidate""",
)
def _anti_vector_rank(spark, sf):
    v = X.item_vectors(spark, sf)
    anchors = R.mean_vector(v.where("label in (0, 1)"), ["label"])
    one = lambda label: anchors.where(C("label") == label).select("vec").scalar()
    rows = v.select(F.floor(C("item_id") / 4).alias("candidate"), "vec")
    out = R.anti_vector_rank(rows, one(0), one(1))
    return out.select("candidate", R6("positive_mean"), R6("negative_max"), R6("score"))
