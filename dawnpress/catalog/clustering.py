"""Graph, clustering and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnpress.catalog.base import query
from dawnpress.catalog.ranking import article_vectors
from dawnpress.catalog.sql import ARTICLES, with_tables
from dawnpress.catalog.text import CATEGORY_RULES, SQL_LENIENT, SQL_LONG, SQL_SPANS, sql_clean, sql_tokens, sql_word_regex, words
from dawnpress.functions import text as T
from dawnpress.functions import wordlists as W
from dawnpress.operators import clustering as K
from dawnpress.operators import labels as L
from dawnpress.operators.graph import connected_components, sized_components
from dawnpress.operators.spherical import spherical_kmeans
from dawnpress.sources import fixtures as X

C = F.col
R6 = lambda name: F.round(name, 6).alias(name)

ENTITIES = f"""
ents AS (SELECT DISTINCT item_id, unnest({SQL_LENIENT.replace('(text,', '(headline,')}) AS entity FROM articles),
rare AS (SELECT entity FROM ents GROUP BY entity HAVING count(*) >= 2 AND ln(((SELECT count(*) FROM articles) + 1) / (count(*) + 1)::DOUBLE) + 1 >= 4.5),
kept AS (SELECT * FROM ents JOIN rare USING (entity)),
pairs AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM kept a JOIN kept b ON a.entity = b.entity AND a.item_id < b.item_id
          GROUP BY 1, 2 HAVING count(*) >= 2)"""


def items(spark, sf):
    return X.articles(spark, sf).withColumn("raw_headline", C("headline"))


@query(
    "entity_frequency",
    with_tables(" SELECT entity, count(*) AS df FROM ents GROUP BY entity", ARTICLES, ENTITIES),
)
def _entity_frequency(spark, sf):
    return K.document_frequency(K.headline_entities(items(spark, sf)), "entity")


@query("shared_entity_pairs", with_tables(" SELECT a, b, shared FROM pairs", ARTICLES, ENTITIES))
def _shared_entity_pairs(spark, sf):
    rows = items(spark, sf)
    return K.shared_entity_pairs(K.headline_entities(rows), total=rows.count())


COMPONENTS = """
sym AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT x AS node, x AS root FROM sym UNION SELECT s.y, r.root FROM reach r JOIN sym s ON s.x = r.node),
comp AS (SELECT node AS item_id, min(root) AS component FROM reach GROUP BY node)"""


@query(
    "connected_components",
    with_tables(
        " SELECT item_id, coalesce(component, item_id) AS component FROM articles LEFT JOIN comp USING (item_id)",
        ARTICLES,
        ENTITIES,
        COMPONENTS,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _components(spark, sf):
    rows = items(spark, sf)
    return connected_components(K.shared_entity_links(K.headline_entities(rows), total=rows.count()), rows)


@query(
    "entity_graph_clusters",
    with_tables(
        """ SELECT component AS cluster_id, item_id, size FROM (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM comp) WHERE size >= 3""",
        ARTICLES,
        ENTITIES,
        COMPONENTS,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _entity_graph_clusters(spark, sf):
    return K.entity_graph_clusters(items(spark, sf)).select("cluster_id", "item_id", "size")


SQL_NEWS_CATEGORY = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(lower(headline || ' ' || summary), '{sql_word_regex(w)}') THEN '{n}'" for n, w in W.CATEGORY_WORDS.items())
    + " ELSE 'other' END"
)
EVENTS = f"""
eg AS (SELECT * FROM (SELECT component AS cluster_id, item_id, count(*) OVER (PARTITION BY component) AS size FROM comp) WHERE size >= 3),
ea AS (SELECT cluster_id, size, a.*, {SQL_NEWS_CATEGORY} AS category,
   row_number() OVER (PARTITION BY cluster_id ORDER BY published_utc DESC, a.item_id DESC) AS place FROM eg JOIN articles a ON a.item_id = eg.item_id),
em AS (SELECT cluster_id, category FROM (SELECT cluster_id, category, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(pos)) AS r
   FROM ea GROUP BY cluster_id, category) WHERE r = 1),
ee AS (SELECT cluster_id, entity, count(*) AS n FROM eg JOIN ents USING (item_id) GROUP BY ALL),
et AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, entity) AS r FROM ee),
el AS (SELECT cluster_id, '[' || string_agg('{{"entity":"' || entity || '","count":' || n || '}}', ',' ORDER BY r) || ']' AS entities FROM et WHERE r <= 15 GROUP BY 1),
ef AS (SELECT cluster_id, max(size) AS size, count(DISTINCT topic_name) AS source_diversity,
   round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(published_utc))) / 86400000000.0, 6) AS age_days,
   substr(sha256(min(CASE WHEN place = 1 THEN headline || '|' || link END)), 1, 16) AS story_id,
   CAST(to_json(list(headline ORDER BY place) FILTER (WHERE place <= 7 AND headline <> '')) AS VARCHAR) AS key_facts FROM ea GROUP BY cluster_id)"""


@query(
    "event_objects",
    with_tables(
        """ SELECT story_id, cluster_id, category AS topic_category, size, source_diversity, age_days, coalesce(entities, '[]') AS entities, key_facts
FROM ef JOIN em USING (cluster_id) LEFT JOIN el USING (cluster_id)""",
        ARTICLES,
        ENTITIES,
        COMPONENTS,
        EVENTS,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _event_objects(spark, sf):
    rows = items(spark, sf)
    return K.event_objects(K.entity_graph_clusters(rows), rows, X.now()).select(
        "story_id", "cluster_id", "topic_category", "size", "source_diversity", F.round("age_days", 6).alias("age_days"),
        F.to_json("entities").alias("entities"), F.to_json("key_facts").alias("key_facts"),
    )


# --- term weights and vectors ----------------------------------------------------------------------------------------

TITLE_TERMS = f"""
terms AS (SELECT item_id, unnest({sql_tokens(sql_clean('headline'))}) AS token FROM articles),
counts AS (SELECT item_id, token, count(*) AS c FROM terms GROUP BY ALL),
idf AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM articles) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM counts GROUP BY token),
weights AS (SELECT item_id, token, (1 + ln(1 + c)) * idf AS w FROM counts JOIN idf USING (token)),
units AS (SELECT item_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM weights)"""


def title_units(spark, sf):
    rows = items(spark, sf)
    terms = rows.select("item_id", F.explode(T.tokenize(T.clean_text(C("headline")))).alias("token"))
    return K.term_weights(terms, X.article_count(spark, sf))


@query("title_weights", with_tables(" SELECT item_id, token, round(w, 6) AS w FROM weights", ARTICLES, TITLE_TERMS))
def _title_weights(spark, sf):
    return title_units(spark, sf).select("item_id", "token", R6("w"))


MEMBERS = """
vecs AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
av AS (SELECT item_id, CAST(label AS BIGINT) AS cluster_id, vec FROM articles JOIN vecs ON vec_id = item_id % (SELECT count(*) FROM embeddings)),
cdim AS (SELECT cluster_id, d, sum(vec[d]) AS s FROM av, (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL),
cent0 AS (SELECT cluster_id, list(s ORDER BY d) AS c FROM cdim GROUP BY cluster_id),
cent AS (SELECT cluster_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM cent0),
sims AS (SELECT av.cluster_id, item_id, list_dot_product(vec, c) AS sim FROM av JOIN cent USING (cluster_id)),
coh AS (SELECT cluster_id, count(*) AS size, avg(sim) AS cohesion FROM sims GROUP BY 1)"""


def members(spark, sf):
    """Clusters given by the label of each article's vector."""
    labels = X.item_vectors(spark, sf).select(C("item_id").alias("vec_id"), C("label").cast("bigint").alias("cluster_id"))
    n = X.table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    rows = X.articles(spark, sf).select("item_id", (C("item_id") % n).alias("vec_id"))
    return rows.join(labels, "vec_id").select("cluster_id", "item_id")


def vectors(spark, sf):
    return article_vectors(spark, sf).select("item_id", "vec")


@query(
    "title_similarity",
    with_tables(
        """,
mu AS (SELECT cluster_id, item_id, token, w FROM av JOIN units USING (item_id)),
sm AS (SELECT cluster_id, token, sum(w) AS s FROM mu GROUP BY ALL),
dt AS (SELECT mu.cluster_id, item_id, sum(w * (s - w)) AS dot FROM mu JOIN sm ON sm.cluster_id = mu.cluster_id AND sm.token = mu.token GROUP BY ALL)
SELECT cluster_id, item_id, round(coalesce(dot, 0) / (count(*) OVER (PARTITION BY cluster_id) - 1), 6) AS mean_similarity
FROM av LEFT JOIN dt USING (cluster_id, item_id)""",
        ARTICLES,
        TITLE_TERMS,
        MEMBERS,
    ),
)
def _title_similarity(spark, sf):
    out = K.title_similarity(members(spark, sf), K.unit_weights(title_units(spark, sf)))
    return out.select("cluster_id", "item_id", R6("mean_similarity"))


@query(
    "cluster_cohesion",
    with_tables(" SELECT cluster_id, size, round(cohesion, 6) AS cohesion FROM coh", ARTICLES, MEMBERS),
)
def _cohesion(spark, sf):
    return K.cohesion(members(spark, sf), vectors(spark, sf)).select("cluster_id", "size", R6("cohesion"))


@query(
    "clusters_of_size",
    with_tables(
        """ SELECT topic_id::BIGINT AS cluster_id, item_id FROM (SELECT *, count(*) OVER (PARTITION BY topic_id) AS n FROM articles) WHERE n >= 40""",
        ARTICLES,
    ),
)
def _clusters_of_size(spark, sf):
    rows = X.articles(spark, sf).select(C("topic_id").cast("bigint").alias("cluster_id"), "item_id")
    return K.clusters_of_size(rows, 40)


SQL_CATEGORY = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(lower(headline || ' ' || summary), '{sql_word_regex(w)}') THEN '{n}'" for n, w in CATEGORY_RULES.items())
    + " ELSE 'other' END"
)
SQL_STRICT = (
    f"list_filter({SQL_SPANS.replace('(text,', '(headline,')}, lambda s: length(s) >= 3 AND NOT list_has_any(string_split(s, ' '), "
    f"{words([*W.CLUSTER_STOPWORDS, *W.STORY_BAD_TOKENS, *W.STORY_BAD_PARTS])}))"
)
GATED = f"""
halves AS (SELECT item_id, CAST(topic_id // 10 AS BIGINT) AS cluster_id FROM articles),
feat AS (SELECT item_id, {SQL_CATEGORY} AS category,
   list_distinct(list_concat({SQL_STRICT}, ['entity_group_' || (item_id % 19)])) AS ents,
   list_distinct(list_concat(list_transform(range(1, len({SQL_LONG})), lambda i: ({SQL_LONG})[i] || '_' || ({SQL_LONG})[i+1]),
     list_transform(range(1, len({SQL_LONG}) - 1), lambda i: ({SQL_LONG})[i] || '_' || ({SQL_LONG})[i+1] || '_' || ({SQL_LONG})[i+2]))) AS grams FROM articles),
edf AS (SELECT e, count(*) AS df FROM (SELECT unnest(ents) AS e FROM feat) GROUP BY e HAVING ln(((SELECT count(*) FROM articles) + 1) / (count(*) + 1)::DOUBLE) + 1 >= 4.2),
gdf AS (SELECT g FROM (SELECT unnest(grams) AS g FROM feat) GROUP BY g HAVING ln(((SELECT count(*) FROM articles) + 1) / (count(*) + 1)::DOUBLE) + 1 >= 5.2),
el AS (SELECT cluster_id, item_id, e FROM (SELECT item_id, unnest(ents) AS e FROM feat) JOIN edf USING (e) JOIN halves USING (item_id)),
gl AS (SELECT cluster_id, item_id, g FROM (SELECT item_id, unnest(grams) AS g FROM feat) JOIN gdf USING (g) JOIN halves USING (item_id)),
es AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS n FROM el a JOIN el b ON a.cluster_id = b.cluster_id AND a.e = b.e AND a.item_id < b.item_id GROUP BY 1, 2),
ec AS (SELECT a, b FROM es JOIN feat fa ON fa.item_id = a JOIN feat fb ON fb.item_id = b
  WHERE n >= CASE WHEN fa.category = 'politics' OR fb.category = 'politics' THEN 3 ELSE 2 END),
gc AS (SELECT a.item_id AS a, b.item_id AS b FROM gl a JOIN gl b ON a.cluster_id = b.cluster_id AND a.g = b.g AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) >= 2),
gated AS (SELECT p.a AS src, p.b AS dst FROM (SELECT * FROM ec UNION SELECT * FROM gc) p JOIN av va ON va.item_id = p.a JOIN av vb ON vb.item_id = p.b
  WHERE list_dot_product(va.vec, vb.vec) >= -0.1)"""


@query("gated_pairs", with_tables(" SELECT src, dst FROM gated", ARTICLES, MEMBERS, GATED))
def _gated_pairs(spark, sf):
    return gated(spark, sf)


def gated(spark, sf, links_only=False):
    from dawnpress.plans.story import story_features
    from dawnpress.session import cut_lineage

    features = cut_lineage(story_features(items(spark, sf), categories=CATEGORY_RULES))
    frequency = K.document_frequency(features.select("item_id", F.explode("entities").alias("entity")), "entity")
    return K.gated_pairs(halves(spark, sf), features.join(vectors(spark, sf), "item_id"), frequency, gate=-0.1, links_only=links_only)


def halves(spark, sf):
    """Two large clusters of ten sources each."""
    return X.articles(spark, sf).select(F.floor(C("topic_id") / 10).alias("cluster_id"), "item_id")


SPLIT = """
sym3 AS (SELECT src AS x, dst AS y FROM gated UNION SELECT dst, src FROM gated),
reach3 AS (SELECT x AS node, x AS root FROM sym3 UNION SELECT s.y, r.root FROM reach3 r JOIN sym3 s ON s.x = r.node)"""


@query(
    "split_clusters",
    with_tables(" SELECT min(root) AS cluster_id, node AS item_id FROM reach3 GROUP BY node", ARTICLES, MEMBERS, GATED, SPLIT).replace(
        "WITH ", "WITH RECURSIVE ", 1
    ),
)
def _split_clusters(spark, sf):
    return K.split_clusters(halves(spark, sf), gated(spark, sf, links_only=True), 2)


# One member of a cluster leaves per round; the others give up their similarity to it.
PRUNE = """
pu AS (SELECT cluster_id, item_id, token, w FROM av JOIN units USING (item_id)),
ps AS (SELECT x.cluster_id, x.item_id AS a, y.item_id AS b, sum(x.w * y.w) AS sim
       FROM pu x JOIN pu y ON y.cluster_id = x.cluster_id AND y.token = x.token AND y.item_id <> x.item_id GROUP BY ALL),
peel AS (
  SELECT 0 AS round, av.cluster_id, av.item_id, coalesce(sum(sim), 0) AS dot, count(*) OVER (PARTITION BY av.cluster_id) AS n
  FROM av LEFT JOIN ps ON ps.cluster_id = av.cluster_id AND ps.a = av.item_id GROUP BY av.cluster_id, av.item_id
  UNION ALL
  SELECT round + 1, w.cluster_id, w.item_id, w.dot - coalesce(ps.sim, 0), n - 1 FROM (
    SELECT *, first_value(item_id) OVER (PARTITION BY cluster_id ORDER BY round(dot / greatest(1, n - 1), 12), item_id) AS worst,
      min(round(dot / greatest(1, n - 1), 12)) OVER (PARTITION BY cluster_id) AS low FROM peel) w
  LEFT JOIN ps ON ps.cluster_id = w.cluster_id AND ps.a = w.item_id AND ps.b = w.worst
  WHERE w.item_id <> w.worst AND low < 0.01 AND n >= 3),
ends AS (SELECT *, min(round(dot / greatest(1, n - 1), 12)) OVER (PARTITION BY cluster_id, round) AS low FROM peel)"""


@query(
    "prune_by_titles",
    with_tables(" SELECT cluster_id, item_id FROM ends WHERE low >= 0.01 AND n >= 3", ARTICLES, TITLE_TERMS, MEMBERS, PRUNE).replace(
        "WITH ", "WITH RECURSIVE ", 1
    ),
)
def _prune(spark, sf):
    return K.prune_by_titles(members(spark, sf), K.unit_weights(title_units(spark, sf)), min_mean=0.01)


MERGE = """
tc AS (SELECT item_id, topic_cluster_id::BIGINT AS cluster_id, vec FROM av JOIN articles USING (item_id)),
td AS (SELECT cluster_id, d, sum(vec[d]) AS s FROM tc, (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL),
t0 AS (SELECT cluster_id, list(s ORDER BY d) AS c FROM td GROUP BY cluster_id),
tm AS (SELECT a.cluster_id AS a, b.cluster_id AS b FROM t0 a JOIN t0 b ON a.cluster_id < b.cluster_id WHERE list_cosine_similarity(a.c, b.c) >= 0.35),
ce AS (SELECT DISTINCT cluster_id, entity FROM tc JOIN ents USING (item_id)),
pairs2 AS (SELECT a, b FROM tm JOIN ce x ON x.cluster_id = a JOIN ce y ON y.cluster_id = b AND y.entity = x.entity GROUP BY a, b HAVING count(*) >= 1),
sym2 AS (SELECT a AS x, b AS y FROM pairs2 UNION SELECT b, a FROM pairs2),
reach2 AS (SELECT x AS node, x AS root FROM sym2 UNION SELECT s.y, r.root FROM reach2 r JOIN sym2 s ON s.x = r.node),
comp2 AS (SELECT node, min(root) AS root FROM reach2 GROUP BY node)"""


@query(
    "merge_clusters",
    with_tables(
        " SELECT coalesce(root, cluster_id) AS cluster_id, item_id FROM tc LEFT JOIN comp2 ON node = cluster_id", ARTICLES, ENTITIES, MEMBERS, MERGE
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _merge_clusters(spark, sf):
    rows = items(spark, sf)
    clusters = rows.select(C("topic_cluster_id").cast("bigint").alias("cluster_id"), "item_id")
    return K.merge_clusters(clusters, vectors(spark, sf), K.headline_entities(rows), merge_sim=0.35)


CORES = f"""
cat AS (SELECT item_id, pos, headline, link, topic_name, published_utc, {SQL_CATEGORY} AS category, cluster_id, sim FROM articles JOIN sims USING (item_id)),
catn AS (SELECT cluster_id, category, count(*) AS n, min(pos) AS first FROM cat GROUP BY ALL),
modes AS (SELECT cluster_id, category FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS r FROM catn) WHERE r = 1),
entn AS (SELECT cluster_id, entity, count(*) AS n FROM (SELECT cluster_id, unnest({SQL_STRICT}) AS entity FROM cat) GROUP BY ALL),
entt AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, entity) AS r FROM entn),
entl AS (SELECT cluster_id, string_agg(entity || ':' || n, ',' ORDER BY r) AS entities FROM entt WHERE r <= 15 GROUP BY 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(sim, 12) DESC, item_id DESC) AS place FROM cat),
facts AS (SELECT cluster_id, string_agg(headline, '|' ORDER BY place) AS key_facts FROM placed WHERE place <= 7 GROUP BY 1),
cores AS (SELECT c.cluster_id, m.category AS topic_category, count(*) AS size, round(any_value(cohesion), 6) AS cohesion, count(DISTINCT topic_name) AS source_diversity,
   round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(published_utc))) / 86400000000.0, 6) AS age_days
  FROM cat c JOIN coh USING (cluster_id) JOIN modes m USING (cluster_id) GROUP BY 1, 2)"""


@query(
    "cluster_cores",
    with_tables(
        """ SELECT cluster_id, topic_category, size, cohesion, source_diversity, age_days, coalesce(entities, '') AS entities, md5(key_facts) AS key_facts,
  CASE topic_category WHEN 'business' THEN 'markets' WHEN 'politics' THEN 'policy' WHEN 'tech' THEN 'tech_industry' ELSE topic_category END AS bucket,
  round(1.3 * size + 1.4 * source_diversity + 7.5 * cohesion + 8 * exp(-age_days / 5), 4) AS rank_score
FROM cores LEFT JOIN entl USING (cluster_id) JOIN facts USING (cluster_id)""",
        ARTICLES,
        MEMBERS,
        CORES,
    ),
)
def _cluster_cores(spark, sf):
    cores = cores_of(spark, sf)
    listed = F.transform("entities", lambda e: F.concat(e["entity"], F.lit(":"), e["count"].cast("string")))
    return cores.select(
        "cluster_id", "topic_category", "size", R6("cohesion"), "source_diversity", R6("age_days"),
        F.array_join(listed, ",").alias("entities"), F.md5(F.array_join("key_facts", "|")).alias("key_facts"),
        "bucket", F.round("rank_score", 4).alias("rank_score"),
    )


def cores_of(spark, sf):
    rows = items(spark, sf)
    described = rows.withColumn("category", T.category(F.concat_ws(" ", "headline", "summary"), CATEGORY_RULES))
    cores = K.cluster_cores(members(spark, sf), described, vectors(spark, sf), X.now(), min_cohesion=0.0)
    return K.with_bucket_and_score(cores)


QUOTAS = {"tech_industry": 1, "markets": 2, "policy": 1, "sports": 1, "other_words": 1}


@query(
    "select_by_quota",
    with_tables(
        """,
b AS (SELECT cluster_id, CASE topic_category WHEN 'business' THEN 'markets' WHEN 'politics' THEN 'policy' WHEN 'tech' THEN 'tech_industry' ELSE topic_category END AS bucket,
      1.3 * size + 1.4 * source_diversity + 7.5 * cohesion + 8 * exp(-age_days / 5) AS s FROM cores),
q AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY s DESC, cluster_id) AS r, CASE bucket WHEN 'tech_industry' THEN 1 WHEN 'markets' THEN 2 WHEN 'policy' THEN 1
       WHEN 'sports' THEN 1 WHEN 'other_words' THEN 1 ELSE 0 END AS quota FROM b),
f AS (SELECT *, row_number() OVER (ORDER BY s DESC, cluster_id) AS fr FROM q WHERE r > quota)
SELECT cluster_id, bucket, 'quota' AS picked_by FROM q WHERE r <= quota
UNION ALL SELECT cluster_id, bucket, 'fill' FROM f WHERE fr <= 6 - (SELECT count(*) FROM q WHERE r <= quota)""",
        ARTICLES,
        MEMBERS,
        CORES,
    ),
)
def _select_by_quota(spark, sf):
    return K.select_by_quota(cores_of(spark, sf), QUOTAS, key="cluster_id").select("cluster_id", "bucket", "picked_by")


INDEXED = f"""
it AS (SELECT item_id, unnest({sql_tokens('headline')}) AS token FROM articles
  UNION ALL SELECT item_id, 'ent_' || e FROM (SELECT item_id, unnest(list_distinct(list_concat({SQL_STRICT}, ['entity_group_' || (item_id % 19)]))) AS e FROM articles),
    (SELECT unnest(range(0, 2)) AS twice)),
ic AS (SELECT item_id, token, count(*) AS c FROM it GROUP BY ALL),
iw AS (SELECT item_id, token, (1 + ln(1 + c)) * (ln(((SELECT count(*) FROM articles) + 1) / (count(*) OVER (PARTITION BY token) + 1)::DOUBLE) + 1) AS w FROM ic),
ih AS (SELECT item_id, w, md5('1337|' || token || '|' || i) AS h FROM iw, (SELECT unnest(range(0, 10)) AS i)),
ix AS (SELECT item_id, ('0x' || substr(h, 1, 8))::BIGINT % 256 AS d, sum(CASE WHEN substr(h, 9, 1) < '8' THEN -w ELSE w END) AS x FROM ih GROUP BY ALL),
iu AS (SELECT item_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS x FROM ix)"""


@query(
    "random_index_vectors",
    with_tables(
        " SELECT item_id, round(sum(x * (d + 1)), 5) AS checksum, round(max(x), 6) AS most, round(min(x), 6) AS least FROM iu GROUP BY item_id",
        ARTICLES,
        INDEXED,
    ),
)
def _random_index_vectors(spark, sf):
    rows = items(spark, sf)
    out = K.random_index_vectors(K.embedding_terms(rows), rows.count())
    weighted = F.zip_with("vec", F.sequence(F.lit(1), F.size("vec")), lambda x, d: x * d)
    return out.select(
        "item_id", F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 5).alias("checksum"),
        F.round(F.array_max("vec"), 6).alias("most"), F.round(F.array_min("vec"), 6).alias("least"),
    )


def sql_kmeans(k: int, iterations: int, seed: int = 1337, dim: int = 64) -> str:
    """The rounds one after another over (item_id, vec) of ``av``; a round that moves few leaves the centres as they are."""
    sums = f"SELECT cluster, d, sum(CAST(round(u[d] * 4294967296) AS BIGINT))::DOUBLE AS s FROM {{a}} JOIN un USING (item_id), (SELECT unnest(range(1, {dim + 1})) AS d) GROUP BY ALL"
    parts = [
        "un AS MATERIALIZED (SELECT item_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS u FROM av WHERE list_dot_product(vec, vec) > 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, item_id) - 1 AS cluster, u AS c FROM"
        f" (SELECT *, md5('{seed}|' || item_id) AS h FROM un) ORDER BY h, item_id LIMIT {k})",
        "a0 AS (SELECT item_id, -1::BIGINT AS cluster FROM un)",
    ]
    for i in range(1, iterations + 1):
        parts += [
            f"a{i} AS MATERIALIZED (SELECT item_id, arg_min(cluster, (-round(list_dot_product(u, c), 9), cluster)) AS cluster FROM un, c{i - 1} GROUP BY item_id)",
            f"m{i} AS MATERIALIZED (SELECT count(*) FILTER (a.cluster <> p.cluster) <= greatest(1, floor(0.01 * count(*))) AS done FROM a{i} a JOIN a{i - 1} p USING (item_id))",
            f"s{i} AS (SELECT cluster, list(s ORDER BY d) AS s FROM ({sums.format(a=f'a{i}')}) GROUP BY cluster)",
            f"c{i} AS MATERIALIZED (SELECT cluster, CASE WHEN done OR s IS NULL OR list_dot_product(s, s) = 0 THEN c ELSE list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) END AS c"
            f" FROM c{i - 1} LEFT JOIN s{i} USING (cluster), m{i})",
        ]
    return ",\n".join(parts)


@query(
    "spherical_kmeans",
    with_tables(" SELECT CAST(cluster AS INTEGER) AS cluster_id, item_id FROM a18", ARTICLES, MEMBERS, sql_kmeans(20, 18)),
)
def _spherical_kmeans(spark, sf):
    return spherical_kmeans(vectors(spark, sf), k=20)


@query("story_clusters")
def _story_clusters(spark, sf):
    """The whole pipeline over every article."""
    from dawnpress.plans.story import story_clusters

    cores, _ = story_clusters(
        X.articles(spark, sf), X.now(), k=60, min_cohesion=0.3, min_title=0.05, categories=CATEGORY_RULES
    )
    return cores.select("story_id", "cluster_id", "bucket", "size", R6("cohesion"), R6("rank_score"), F.to_json("entities").alias("entities"))


# --- labels ----------------------------------------------------------------------------------------------------------

SQL_LABELS = """
cache AS (SELECT substr(sha256(link || '|' || headline), 1, 16) AS key, regexp_extract(headline, '^(?:[^ ]+ ){0,1}[^ ]+') AS event FROM articles WHERE topic_id <> 3),
lab0 AS (SELECT item_id, trim(regexp_replace(regexp_replace(event, '<[^>]+>', ' ', 'g'), '[^\\p{L}\\p{N}_\\s&/-]+', '', 'g')) AS bare FROM articles
         JOIN cache ON key = substr(sha256(link || '|' || headline), 1, 16)),
lab AS (SELECT item_id, CASE WHEN bare = '' THEN 'General' ELSE array_to_string(list_transform(string_split(regexp_replace(bare, ' +', ' ', 'g'), ' '), lambda w: CASE WHEN w = upper(w) AND w <> lower(w) AND length(w) <= 6
   THEN w ELSE replace(upper(substr(w, 1, 1)), 'ẞ', 'SS') || lower(substr(w, 2)) END), ' ') END AS label FROM lab0)"""


SQL_ALL_LABELS = SQL_LABELS.replace(" WHERE topic_id <> 3", "")


def label_cache(spark, sf):
    """Labels of all articles."""
    return (
        X.articles(spark, sf)
        .select(L.item_key(C("link"), C("headline")).alias("key"), F.regexp_extract("headline", "^(?:[^ ]+ ){0,1}[^ ]+", 0).alias("event"))
    )


@query(
    "cached_labels",
    with_tables(
        """ SELECT item_id, label FROM lab UNION ALL SELECT item_id, NULL FROM articles WHERE topic_id = 3""", ARTICLES, SQL_LABELS
    ),
)
def _cached_labels(spark, sf):
    """The cache lacks the articles of one source, which stay to be labelled."""
    rows = X.articles(spark, sf)
    kept = rows.where("topic_id <> 3").select(L.item_key(C("link"), C("headline")).alias("key"))
    known, needed = L.cached_labels(rows, label_cache(spark, sf).join(kept, "key", "left_semi"))
    return known.select("item_id", "label").unionByName(needed.select("item_id", F.lit(None).cast("string").alias("label")))


@query(
    "label_clusters",
    with_tables(
        """ SELECT min(item_id) OVER w AS cluster_id, item_id, label AS event_label, count(*) OVER w AS size FROM lab WHERE label <> 'General'
WINDOW w AS (PARTITION BY label) QUALIFY count(*) OVER w >= 3""",
        ARTICLES,
        SQL_ALL_LABELS,
    ),
)
def _label_clusters(spark, sf):
    known, _ = L.cached_labels(X.articles(spark, sf), label_cache(spark, sf))
    return L.label_clusters(known.select("item_id", "label"), threshold=None)


@query("merged_labels")
def _merged_labels(spark, sf):
    known, _ = L.cached_labels(X.articles(spark, sf), label_cache(spark, sf))
    return L.merge_labels(known.select("label"), 0.85)


@query("label_clusters_fuzzy")
def _label_clusters_fuzzy(spark, sf):
    known, _ = L.cached_labels(X.articles(spark, sf), label_cache(spark, sf))
    return L.label_clusters(known.select("item_id", "label"), threshold=0.85)
