"""Evaluation, segment, training-table and model-parameter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnpress.catalog.base import query
from dawnpress.catalog.ranking import user_vectors
from dawnpress.catalog.sql import ARTICLES, INTERACTION_EVENTS, INTERACTIONS, PROFILES, with_tables
from dawnpress.catalog.windows import RUNS, SQL_TOKEN, runs, tokens
from dawnpress.functions import segments as G
from dawnpress.operators import evaluation as E
from dawnpress.operators import learning as M
from dawnpress.sources import files
from dawnpress.sources import fixtures as X
from dawnpress.sources.profiles import profile_lookup

C = F.col
R6 = lambda name: F.round(name, 6).alias(name)

SESSIONS = """
sess AS (SELECT condition, user_type AS persona, session_id, count(*)::DOUBLE AS steps, avg(reward) AS avg_reward, avg((reason = 'auto')::DOUBLE) AS auto_rate,
  avg((reason = 'skip')::DOUBLE) AS skip_rate, avg(interest) AS avg_watch_ratio FROM interaction_events GROUP BY ALL),
pers AS (SELECT condition, persona, count(*)::DOUBLE AS sessions, avg(steps) AS avg_steps, avg(avg_reward) AS avg_reward, avg(auto_rate) AS auto_rate, avg(skip_rate) AS skip_rate,
  avg(avg_watch_ratio) AS avg_watch_ratio FROM sess GROUP BY ALL)"""
METRIC_COLUMNS = ["avg_steps", "avg_reward", "auto_rate", "skip_rate", "avg_watch_ratio"]


def eval_sessions(spark, sf):
    return E.session_metrics(X.interaction_events(spark, sf).withColumn("persona", C("user_type")))


@query(
    "session_metrics",
    with_tables(
        """ SELECT condition, persona, session_id, steps, round(avg_reward, 5) AS avg_reward, round(auto_rate, 5) AS auto_rate, round(skip_rate, 5) AS skip_rate,
  round(avg_watch_ratio, 6) AS avg_watch_ratio FROM sess""",
        INTERACTION_EVENTS,
        SESSIONS,
    ),
)
def _session_metrics(spark, sf):
    r5 = lambda n: F.round(n, 5).alias(n)
    return eval_sessions(spark, sf).select(
        "condition", "persona", "session_id", "steps", r5("avg_reward"), r5("auto_rate"), r5("skip_rate"), R6("avg_watch_ratio")
    )


@query(
    "persona_metrics",
    with_tables(
        " SELECT condition, persona, sessions, " + ", ".join(f"round({c}, 6) AS {c}" for c in METRIC_COLUMNS) + " FROM pers",
        INTERACTION_EVENTS,
        SESSIONS,
    ),
)
def _persona_metrics(spark, sf):
    return E.persona_metrics(eval_sessions(spark, sf)).select("condition", "persona", "sessions", *[R6(c) for c in METRIC_COLUMNS])


@query(
    "condition_metrics",
    with_tables(
        " SELECT condition, round(avg(avg_reward), 6) AS avg_reward_over_sessions, round(avg(steps), 6) AS avg_steps_over_sessions FROM sess GROUP BY condition",
        INTERACTION_EVENTS,
        SESSIONS,
    ),
)
def _condition_metrics(spark, sf):
    return E.condition_metrics(eval_sessions(spark, sf)).select("condition", R6("avg_reward_over_sessions"), R6("avg_steps_over_sessions"))


@query(
    "compare_conditions",
    with_tables(
        """,
p2 AS (SELECT CASE WHEN persona IN ('seg0', 'seg1') THEN 'first' ELSE 'second' END AS persona, condition, avg(avg_reward) AS r FROM sess GROUP BY ALL)
SELECT persona, round(max(r) FILTER (WHERE condition = 'a'), 6) AS a, round(max(r) FILTER (WHERE condition = 'b'), 6) AS b,
  round(max(r) FILTER (WHERE condition = 'b') - max(r) FILTER (WHERE condition = 'a'), 6) AS delta FROM p2 GROUP BY persona""",
        INTERACTION_EVENTS,
        SESSIONS,
    ),
)
def _compare(spark, sf):
    grouped = eval_sessions(spark, sf).withColumn("persona", F.when(C("persona").isin("seg0", "seg1"), "first").otherwise("second"))
    chosen = E.select_segments(grouped, "all", ["first", "second"])
    return E.compare_conditions(E.persona_metrics(chosen), "a", "b").select("persona", R6("a"), R6("b"), R6("delta"))


@query(
    "evaluation_report",
    with_tables(
        " SELECT condition, persona, round(avg_reward, 6) AS avg_reward FROM pers", INTERACTION_EVENTS, SESSIONS
    ),
)
def _evaluation_report(spark, sf):
    """The report document, read back."""
    sessions = eval_sessions(spark, sf)
    report = files.evaluation_report(E.persona_metrics(sessions), E.condition_metrics(sessions))
    schema = "conditions map<string,struct<personas:map<string,struct<avg_reward:double>>>>"
    spread = report.select(F.explode(F.from_json("value", schema)["conditions"]).alias("condition", "c"))
    rows = spread.select("condition", F.explode("c.personas").alias("persona", "m"))
    return rows.select("condition", "persona", F.round("m.avg_reward", 6).alias("avg_reward"))


@query(
    "run_summary",
    with_tables(
        """,
g AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY run_step DESC) AS back, CASE WHEN run_step % 10 = 0 THEN 10 - reward END AS regret FROM runs)
SELECT condition, count(*) AS interactions, round(avg(reward) FILTER (WHERE back <= 10), 6) AS final_reward, round(avg(regret), 6) AS mean_regret FROM g GROUP BY condition""",
        INTERACTION_EVENTS,
        RUNS,
    ),
)
def _run_summary(spark, sf):
    rows = runs(spark, sf).withColumn("regret", F.when(C("run_step") % 10 == 0, F.lit(10) - C("reward")))
    return E.run_summary(rows, ["condition"], "run_step").select("condition", "interactions", R6("final_reward"), R6("mean_regret"))


@query(
    "replay_positives",
    with_tables(
        """,
p AS (SELECT event_id, condition, CAST(row_number() OVER (PARTITION BY condition ORDER BY run_step DESC) AS INTEGER) AS replay_rank FROM runs WHERE reward >= 4.5)
SELECT event_id, condition, replay_rank FROM p WHERE replay_rank <= 512""",
        INTERACTION_EVENTS,
        RUNS,
    ),
)
def _replay(spark, sf):
    return E.replay_positives(runs(spark, sf), keys=["condition"]).select("event_id", "condition", "replay_rank")


# --- segments -------------------------------------------------------------------------------------------------------


def sql_segment(rule: E.Segment) -> tuple[str, str]:
    """(score, reward) SQL of a segment."""
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    hit = lambda ws: "(" + " OR ".join(f"contains(txt, {quote(w)})" for w in ws) + ")"
    score = "CASE lower(vibe_style) " + " ".join(f"WHEN {quote(n)} THEN {w}" for n, w in rule.weights.items()) + " ELSE 1.0 END::DOUBLE"
    for kind, ws, factor, *more in rule.adjustments:
        if kind == "boost":
            score = f"({score}) * CASE WHEN {hit(ws)} THEN {factor} ELSE 1 END::DOUBLE"
        elif kind == "lift":
            score = f"(CASE WHEN {hit(ws)} THEN greatest(({score}), 1.0) * {factor} ELSE ({score}) END)"
        elif kind == "unless":
            score = f"({score}) * CASE WHEN {hit(ws)} AND NOT {hit(more[0])} THEN {factor} ELSE 1 END::DOUBLE"
        elif kind == "either":
            score = f"({score}) * CASE WHEN {hit(ws)} THEN {factor} ELSE {more[0]} END::DOUBLE"
        else:
            n = " + ".join(f"contains(txt, {quote(w)})::INT" for w in ws)
            score = f"({score}) * CASE WHEN {hit(ws)} THEN {factor} + least({more[1]}, {more[0]} * ({n})) ELSE {more[2]} END::DOUBLE"
    reward = "CASE " + " ".join(f"WHEN score > {a} THEN {r}" for a, r in rule.tiers) + f" ELSE {rule.otherwise} END::DOUBLE"
    return score, reward


SQL_SEGMENTS = (
    "\nstx AS (SELECT item_id, vibe_style, lower(headline || ' ' || topic_name) AS txt FROM articles),\nseg AS ("
    + "\nUNION ALL ".join(
        f"SELECT item_id, '{name}' AS segment, score, {sql_segment(rule)[1]} AS reward FROM (SELECT item_id, {sql_segment(rule)[0]} AS score FROM stx)"
        for name, rule in G.SEGMENTS.items()
    )
    + ")"
)


@query(
    "segment_rewards",
    with_tables(" SELECT item_id, segment, round(score, 6) AS score, reward FROM seg", ARTICLES, SQL_SEGMENTS),
)
def _segment_rewards(spark, sf):
    items = X.articles(spark, sf).select("item_id", "headline", "topic_name", "vibe_style")
    return E.segment_rewards(items, G.SEGMENTS).select("item_id", "segment", R6("score"), "reward")


@query(
    "segment_coverage",
    with_tables(
        " SELECT segment, count(*) AS items, round(avg((reward > 0)::DOUBLE), 6) AS positive_rate FROM seg GROUP BY segment", ARTICLES, SQL_SEGMENTS
    ),
)
def _segment_coverage(spark, sf):
    items = X.articles(spark, sf).select("item_id", "headline", "topic_name", "vibe_style")
    return E.segment_coverage(E.segment_rewards(items, G.SEGMENTS)).select("segment", "items", R6("positive_rate"))


@query(
    "id_segment_scores",
    with_tables(
        """ SELECT item_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.45 - CASE WHEN topic_id IN (2, 3) THEN 0.55 ELSE 0 END + CASE WHEN topic_id IN (5, 6) THEN 0.35 ELSE 0 END
  + CASE WHEN vibe_id IN (1, 4) THEN 0.25 ELSE 0 END)), 6) AS score FROM articles""",
        ARTICLES,
    ),
)
def _id_segment(spark, sf):
    score = E.id_segment_score(C("topic_id"), C("vibe_id"), [5, 6], [2, 3], [1, 4])
    return X.articles(spark, sf).select("item_id", F.round(score, 6).alias("score"))


# --- training and parameters -----------------------------------------------------------------------------------------


@query(
    "training_rows",
    with_tables(
        """,
s AS (SELECT *, list(token) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS seq FROM tokens)
SELECT event_id, array_to_string(list_concat(list_transform(range(0, 30 - coalesce(len(seq), 0)), lambda i: 0), coalesce(seq, [])), ' ') AS event_seq,
  (interest >= 0.95)::DOUBLE AS target_finish, (interest <= 0.2)::DOUBLE AS target_fast_skip, round(greatest(0.05::DOUBLE, least(0.95::DOUBLE, (reward + 10) / 20)), 6) AS reward_norm FROM s""",
        INTERACTIONS,
        SQL_TOKEN,
    ),
)
def _training_rows(spark, sf):
    return M.training_rows(tokens(spark, sf)).select(
        "event_id", F.array_join(C("event_seq").cast("array<string>"), " ").alias("event_seq"), "target_finish", "target_fast_skip", R6("reward_norm")
    )


def scored_heads(spark, sf):
    """All interactions, scored by heads that have seen four fifths of the sessions."""
    targets = {f"target_{n}": c for n, c in _targets().items()}
    rows = X.interactions(spark, sf).withColumns(targets | {"held_out": M.held_out(C("session_id"))})
    models = M.fit_heads(rows.where(~C("held_out")), ["topic_id", "vibe_id", "topic_cluster_id", "user_type"], ["recency_bucket", "step"])
    return M.score_heads(rows, models)


@query("six_head_scores")
def _six_head_scores(spark, sf):
    return scored_heads(spark, sf).select("event_id", "held_out", F.round("pred_score", 4).alias("pred_score"))


@query("head_evaluation")
def _head_evaluation(spark, sf):
    """Losses and calibration of the heads on the sessions they have not seen."""
    found = M.head_measures(scored_heads(spark, sf).where("held_out"))
    return found.select("head", "rows", *[F.round(c, 4).alias(c) for c in ("loss", "base_loss", "calibration")])


def _targets():
    from dawnpress.functions import numeric as N

    return N.watch_targets(C("interest"))


@query("phase_crosstab")
def _phase_crosstab(spark, sf):
    log = X.interaction_events(spark, sf).groupBy("session_id").agg(F.max("step").alias("step"))
    most = log.agg(F.max("step")).scalar()
    users = user_vectors(spark, sf).join(log, "session_id").withColumn("total", most)
    return M.phase_crosstab(users, "step", "total")


PARAMS = """
params AS (SELECT CAST(label % 3 AS INTEGER) AS checkpoint, 'p' || (vec_id % 50) AS param, d - 1 AS idx, avg(embedding[d]::DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(1, 65)) AS d) WHERE NOT (vec_id % 50 = 7 AND label % 3 = 2 AND d > 32) GROUP BY ALL)"""


@query(
    "merge_parameters",
    with_tables(
        """,
shapes AS (SELECT param, checkpoint, count(*) AS n FROM params GROUP BY ALL),
fit AS (SELECT param, count(*) = 3 AND count(DISTINCT n) = 1 AS averaged FROM shapes GROUP BY param HAVING bool_or(checkpoint = 0)),
v AS (SELECT param, idx, averaged, sum(CASE WHEN averaged THEN value * CASE checkpoint WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END::DOUBLE WHEN checkpoint = 0 THEN value END) AS value
      FROM params JOIN fit USING (param) GROUP BY ALL)
SELECT param, idx, averaged, round(value, 6) AS value FROM v WHERE value IS NOT NULL""",
        PARAMS,
    ),
)
def _merge_parameters(spark, sf):
    """Three checkpoints of named tensors, one of which has another shape in one of them."""
    v = X.item_vectors(spark, sf)
    spread = v.select(
        (C("label") % 3).cast("int").alias("checkpoint"), (C("item_id") % 50).alias("_p"), F.posexplode(C("vec").cast("array<double>")).alias("i", "x")
    ).where(~((C("_p") == 7) & (C("checkpoint") == 2) & (C("i") >= 32)))
    long = spread.groupBy("checkpoint", "_p", "i").agg(F.avg("x").alias("value"))
    params = long.select(
        "checkpoint",
        F.concat(F.lit("p"), C("_p").cast("string")).alias("param"),
        F.when((C("_p") == 7) & (C("checkpoint") == 2), "32").otherwise("64").alias("shape"),
        F.lit("float32").alias("dtype"),
        C("i").cast("bigint").alias("idx"),
        "value",
    )
    return E.merge_parameters(params, {0: 5.0, 1: 3.0, 2: 2.0}, 0).select("param", "idx", "averaged", R6("value"))


@query(
    "merge_meta",
    with_tables(" SELECT param AS key, round(max(value), 6) AS value FROM params GROUP BY param", PARAMS),
)
def _merge_meta(spark, sf):
    v = X.item_vectors(spark, sf).select(
        (C("label") % 3).alias("c"), (C("item_id") % 50).alias("p"), F.posexplode(C("vec").cast("array<double>")).alias("i", "x")
    ).where(~((C("p") == 7) & (C("c") == 2) & (C("i") >= 32)))
    meta = v.groupBy("c", "p", "i").agg(F.avg("x").alias("value")).select(F.concat(F.lit("p"), C("p").cast("string")).alias("key"), "value")
    return E.merge_meta(meta).select("key", R6("value"))


@query(
    "profile_lookup",
    with_tables(
        """,
c AS (SELECT collection, 'k' || (c_custkey % 400) AS doc_key, 'k' || (c_custkey % 700) AS uid_field, c_custkey FROM profiles),
m AS (SELECT doc_key AS uid, collection, 0 AS how, doc_key, c_custkey FROM c UNION ALL SELECT uid_field, collection, 1, doc_key, c_custkey FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY collection, how, doc_key, c_custkey) AS rn FROM m),
r AS (SELECT 'k' || user_id AS uid FROM events GROUP BY 1 UNION ALL SELECT 'anon')
SELECT r.uid, f.collection FROM r LEFT JOIN f ON f.uid = r.uid AND rn = 1 AND r.uid <> 'anon'""",
        PROFILES,
    ),
)
def _profile_lookup(spark, sf):
    """Profiles filed under a document key or a uid field in three collections."""
    number = C("uid").cast("bigint")
    stored = X.profiles(spark, sf).select(
        "collection", F.concat(F.lit("k"), (number % 400).cast("string")).alias("doc_key"), F.concat(F.lit("k"), (number % 700).cast("string")).alias("uid_field"), "document"
    )
    users = X.table(spark, sf, "events").select(F.concat(F.lit("k"), C("user_id").cast("string")).alias("uid")).distinct()
    requests = users.unionByName(spark.range(1).select(F.lit("anon").alias("uid")))
    return profile_lookup(requests, stored).select("uid", "collection")
