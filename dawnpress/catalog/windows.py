"""Reward formulas and session-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dawnpress.catalog.base import query
from dawnpress.catalog.sql import ARTICLES, INTERACTION_EVENTS, INTERACTIONS, with_tables
from dawnpress.catalog.text import SQL_DWELL_BUCKET, sql_sentences
from dawnpress.functions import numeric as N
from dawnpress.functions import text as T
from dawnpress.functions import vectors as V
from dawnpress.functions import wordlists as W
from dawnpress.operators import windows as O
from dawnpress.sources import fixtures as X

C = F.col
R6 = lambda name: F.round(name, 6).alias(name)
PER_SESSION = "PARTITION BY session_id ORDER BY step"


def log_rows(spark, sf):
    return X.interaction_events(spark, sf)


@query(
    "interaction_scores",
    with_tables(
        """
SELECT event_id, round(-10 + 2 * dwell, 6) AS watch_reward, round(greatest(0.05::DOUBLE, least(0.95::DOUBLE, (reward + 10) / 20)), 6) AS reward_norm,
  round(greatest(-10.0::DOUBLE, least(10.0::DOUBLE, dwell / 10 * 8 + CASE WHEN interest >= 0.9 THEN 10 ELSE 0 END
     + CASE WHEN interest >= 0.95 THEN 6 ELSE 0 END - CASE WHEN dwell * 1000 < 2000 THEN 6 ELSE 0 END)), 6) AS engagement,
  (interest >= 0.95)::DOUBLE AS finish, (interest <= 0.2)::DOUBLE AS fast_skip, (interest >= 0.85)::DOUBLE AS liked,
  (interest >= 0.95)::DOUBLE AS shared, (interest >= 0.9)::DOUBLE AS rewatch, round(interest, 6) AS watch_time,
  round(greatest(0.04::DOUBLE, 0.18 * exp(-step / 220.0)), 6) AS serving_epsilon,
  round(0.25 + least(1.0::DOUBLE, step / 100.0::DOUBLE) * (0.10 - 0.25), 6) AS training_epsilon
FROM interaction_events""",
        INTERACTION_EVENTS,
    ),
)
def _interaction_scores(spark, sf):
    targets = N.watch_targets(C("interest"))
    names = {"like": "liked", "share": "shared"}
    return log_rows(spark, sf).select(
        "event_id",
        F.round(N.watch_reward(C("dwell")), 6).alias("watch_reward"),
        F.round(N.reward_norm(C("reward")), 6).alias("reward_norm"),
        F.round(
            N.engagement_reward(C("dwell") * 1000, F.lit(10000.0), C("interest") >= 0.9, C("interest") >= 0.95), 6
        ).alias("engagement"),
        *[F.round(c, 6).alias(names.get(n, n)) for n, c in targets.items()],
        F.round(N.serving_epsilon(C("step")), 6).alias("serving_epsilon"),
        F.round(N.training_epsilon(C("step"), F.lit(100)), 6).alias("training_epsilon"),
    )


@query(
    "audio_signals",
    """
SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'auto' ELSE 'skip' END AS reason,
  round(10 * CASE WHEN turn % 3 <> 0 THEN least(1.0::DOUBLE, length(text) * 10.0::DOUBLE / 10000) WHEN turn % 5 = 4 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END, 6) AS dwell
FROM conversations""",
)
def _audio_signals(spark, sf):
    reason, dwell = N.audio_signal(C("skip_index"), C("listen_ms"), C("total_ms"))
    return X.delivered(spark, sf).select(
        C("session_id").cast("bigint").alias("conv_id"), C("position").alias("turn"), reason.alias("reason"), F.round(dwell, 6).alias("dwell")
    )


def sql_logit(head: int) -> str:
    return f"((('0x' || substr(md5(session_id || '|' || item_id), {1 + 4 * head}, 4))::BIGINT % 4000) / 1000.0::DOUBLE - 2)"


HEADS = ["finish", "like", "share", "rewatch", "fast_skip", "watch_time"]


def head_logits(session="session_id", item="item_id"):
    """Stand-in head outputs of a (session, item) pair."""
    digest = F.md5(F.concat_ws("|", C(session), C(item).cast("string")))
    return {
        name: (F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("bigint") % 4000) / 1000.0 - 2
        for i, name in enumerate(HEADS)
    }


def sql_head_score(weights) -> str:
    parts = []
    for i, name in enumerate(HEADS):
        sign = "-" if name == "fast_skip" else "+"
        parts.append(f"{sign} {weights[name]}::DOUBLE / (1 + exp(-{sql_logit(i)}))")
    return "(0 " + " ".join(parts) + ")"


@query(
    "head_scores",
    with_tables(
        f"""
SELECT event_id, round({sql_head_score(W.SERVING_WEIGHTS)}, 6) AS serving_score, round({sql_head_score(W.DEFAULT_WEIGHTS)}, 6) AS model_score
FROM interactions""",
        INTERACTIONS,
    ),
)
def _head_scores(spark, sf):
    heads = head_logits()
    return X.interactions(spark, sf).select(
        "event_id",
        F.round(N.head_score(heads), 6).alias("serving_score"),
        F.round(N.head_score(heads, W.DEFAULT_WEIGHTS), 6).alias("model_score"),
    )


@query(
    "vector_products",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(a, b), 6) AS dot, round(sqrt(list_dot_product(a, a)), 6) AS norm,
  round(list_cosine_similarity(a, b), 6) AS cosine,
  round(list_dot_product(a, a) + list_dot_product(b, b) + list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i] * a[i] * b[i] + (a[i] - b[i]) * (a[i] - b[i]))), 6) AS feature_power,
  CAST(4 * len(a) AS INTEGER) AS feature_size
FROM p""",
)
def _vector_products(spark, sf):
    v = X.item_vectors(spark, sf).select("item_id", C("vec").cast("array<double>").alias("a"))
    following = v.select((C("item_id") - 1).alias("item_id"), C("a").alias("b"))
    features = V.interaction_features(C("a"), C("b"))
    return (
        v.join(following, "item_id")
        .withColumn("f", features)
        .select(
            C("item_id").alias("vec_id"),
            F.round(V.dot(C("a"), C("b")), 6).alias("dot"),
            F.round(V.norm(C("a")), 6).alias("norm"),
            F.round(V.cosine(C("a"), C("b")), 6).alias("cosine"),
            F.round(V.dot(C("f"), C("f")), 6).alias("feature_power"),
            F.size("f").alias("feature_size"),
        )
    )


# --- history --------------------------------------------------------------------------------------------------------

SQL_ADAPTIVE = """
skips AS (SELECT event_id, session_id, step, dwell,
   count(dwell) OVER w AS n, avg(dwell) OVER w AS mu, stddev_pop(dwell) OVER w AS sd
  FROM interaction_events WHERE reason = 'skip'
  WINDOW w AS (PARTITION BY session_id ORDER BY step ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)),
adaptive AS (
  SELECT event_id, session_id, step, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, CASE WHEN n < 12 THEN -8 + 1.6 * dwell
     ELSE 0.75 * 9 * tanh((dwell - mu) / greatest(0.35::DOUBLE, sd) / 1.35) + 0.25 * (-8 + 1.6 * dwell) END)) AS session_reward FROM skips
  UNION ALL SELECT event_id, session_id, step, reward FROM interaction_events WHERE reason <> 'skip')"""


@query(
    "adaptive_rewards",
    with_tables(" SELECT event_id, round(session_reward, 6) AS session_reward FROM adaptive", INTERACTION_EVENTS, SQL_ADAPTIVE),
)
def _adaptive(spark, sf):
    return O.adaptive_rewards(log_rows(spark, sf)).select("event_id", R6("session_reward"))


@query(
    "running_mean_reward",
    with_tables(
        f" SELECT event_id, round(avg(reward) OVER ({PER_SESSION} ROWS UNBOUNDED PRECEDING) * step, 3) AS mean_times_steps FROM interaction_events",
        INTERACTION_EVENTS,
    ),
)
def _running_mean(spark, sf):
    return O.running_mean(log_rows(spark, sf), "reward", "avg_reward").select(
        "event_id", F.round(C("avg_reward") * C("step"), 3).alias("mean_times_steps")
    )


SQL_TOKEN = f"""
tokens AS (SELECT *, CAST(1 + ('0x' || substr(md5('i' || item_id || '|t' || topic_id || '|v' || vibe_id || '|dw' || {SQL_DWELL_BUCKET} || '|sx' || least(9, step // 10)), 1, 8))::BIGINT % 4095 AS INTEGER) AS token
  FROM interactions)"""


def tokens(spark, sf):
    token = N.event_token(C("item_id"), C("topic_id"), C("vibe_id"), C("dwell"), C("step"))
    return X.interactions(spark, sf).withColumn("token", token)


@query(
    "event_sequences",
    with_tables(
        f""",
s AS (SELECT event_id, list(token) OVER ({PER_SESSION} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS seq FROM tokens)
SELECT event_id, array_to_string(list_concat(list_transform(range(0, 30 - len(seq)), lambda i: 0), seq), ' ') AS event_seq FROM s""",
        INTERACTIONS,
        SQL_TOKEN,
    ),
)
def _event_sequences(spark, sf):
    out = O.event_sequences(tokens(spark, sf), "token")
    return out.select("event_id", F.array_join(C("event_seq").cast("array<string>"), " ").alias("event_seq"))


@query(
    "recently_seen",
    with_tables(
        f""" SELECT event_id, coalesce(array_to_string(list(item_id) OVER ({PER_SESSION} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), ' '), '') AS recent_seen
FROM interactions""",
        INTERACTIONS,
    ),
)
def _recently_seen(spark, sf):
    out = O.recently_seen(X.interactions(spark, sf))
    return out.select("event_id", F.array_join(C("recent_seen").cast("array<string>"), " ").alias("recent_seen"))


LATEST = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step DESC) AS seen_rank FROM interactions) WHERE seen_rank <= 60)"""


@query(
    "recent_exposure",
    with_tables(
        """ SELECT session_id, 'topic' AS kind, topic_id AS id, count(*) AS exposures FROM latest GROUP BY ALL
UNION ALL SELECT session_id, 'cluster', topic_cluster_id, count(*) FROM latest GROUP BY ALL""",
        INTERACTIONS,
        LATEST,
    ),
)
def _exposure(spark, sf):
    seen = O.latest_seen(X.interactions(spark, sf))
    parts = [
        O.exposure(seen, c).select("session_id", F.lit(k).alias("kind"), C(c).alias("id"), "exposures")
        for k, c in (("topic", "topic_id"), ("cluster", "topic_cluster_id"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "topic_streaks",
    with_tables(
        """ SELECT event_id, count(b) OVER w = 5 AND coalesce(min(b) OVER w = max(b) OVER w, false) AS same_topic_streak
FROM (SELECT *, topic_id // 10 AS b FROM interactions)
WINDOW w AS (PARTITION BY session_id ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
        INTERACTIONS,
    ),
)
def _topic_streaks(spark, sf):
    coarse = X.interactions(spark, sf).withColumn("topic_id", F.floor(C("topic_id") / 10))
    return O.topic_streaks(coarse).select("event_id", "same_topic_streak")


RUNS = """
runs AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY ts, event_id) AS run_step FROM interaction_events)"""


def runs(spark, sf):
    """Two long runs that share one reward log each."""
    from dawnpress.operators.frames import sequence_number

    return sequence_number(log_rows(spark, sf), ["condition"], ["ts", "event_id"], F.to_date("ts"), "run_step")


@query(
    "rolling_rewards",
    with_tables(
        """ SELECT event_id, run_step, round(avg(reward) OVER (PARTITION BY condition ORDER BY run_step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS avg_5,
  round(avg(reward) OVER (PARTITION BY condition ORDER BY run_step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS avg_50 FROM runs""",
        INTERACTION_EVENTS,
        RUNS,
    ),
)
def _rolling_rewards(spark, sf):
    out = O.rolling_rewards(runs(spark, sf), ["condition"], "run_step")
    return out.select("event_id", "run_step", R6("avg_5"), R6("avg_50"))


@query(
    "panic_epsilon",
    with_tables(
        f""" SELECT event_id, round(CASE WHEN step > 6 AND avg(reward) OVER ({PER_SESSION} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) < 0 THEN 0.35
  ELSE 0.25 + least(1.0::DOUBLE, step / 100.0::DOUBLE) * (0.10 - 0.25) END, 6) AS epsilon FROM interaction_events""",
        INTERACTION_EVENTS,
    ),
)
def _panic(spark, sf):
    return O.panic_epsilon(log_rows(spark, sf), F.lit(100)).select("event_id", R6("epsilon"))


@query(
    "recovery_mode",
    with_tables(
        """,
j AS (SELECT event_id, condition, run_step, coalesce(count(reward) OVER w = 50 AND avg(reward) OVER w < 1.0, false) AS low FROM runs
      WINDOW w AS (PARTITION BY condition ORDER BY run_step ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, max(CASE WHEN NOT low THEN run_step END) OVER (PARTITION BY condition ORDER BY run_step) AS br FROM j)
SELECT event_id, run_step - coalesce(br, 0) AS low_streak, run_step - coalesce(br, 0) > 20 AS recovery FROM b""",
        INTERACTION_EVENTS,
        RUNS,
    ),
)
def _recovery(spark, sf):
    out = O.recovery_mode(runs(spark, sf), ["condition"], "run_step", threshold=1.0)
    return out.select("event_id", "low_streak", "recovery")


@query(
    "bad_domains_as_of",
    with_tables(
        """ SELECT event_id, coalesce(count(reward) OVER w >= 4 AND avg(reward) OVER w <= -3, false) AS bad_domain FROM interactions
WINDOW w AS (PARTITION BY session_id, topic_id ORDER BY step ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
        INTERACTIONS,
    ),
)
def _bad_domains_as_of(spark, sf):
    return O.bad_domains_as_of(X.interactions(spark, sf)).select("event_id", "bad_domain")


@query(
    "bad_domains",
    with_tables(
        """,
l AS (SELECT *, row_number() OVER (PARTITION BY session_id, topic_id ORDER BY step DESC) AS rn FROM interactions)
SELECT session_id, topic_id, count(*) AS n, round(avg(reward), 6) AS mean_reward FROM l WHERE rn <= 12
GROUP BY 1, 2 HAVING count(*) >= 4 AND avg(reward) <= -3""",
        INTERACTIONS,
    ),
)
def _bad_domains(spark, sf):
    return O.bad_domains(X.interactions(spark, sf)).select("session_id", "topic_id", "n", R6("mean_reward"))


@query(
    "noise_and_bleak_flags",
    with_tables(
        """,
f AS (SELECT event_id, session_id, step, regexp_matches(lower(vibe_style), 'angry|rant|sarcastic|clickbait')::INT AS noisy,
      (contains(lower(headline), 'der') OR contains(lower(headline), 'the'))::INT AS bleak FROM interactions)
SELECT event_id,
  count(*) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5
    AND sum(noisy) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 2 AS noise_quit,
  bleak = 1 AND coalesce(sum(bleak) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) >= 3 AS bleak_damped,
  count(*) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = 8
    AND sum(bleak) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) >= 6 AS bleak_quit
FROM f""",
        INTERACTIONS,
    ),
)
def _noise_and_bleak(spark, sf):
    rows = O.noise_flags(X.interactions(spark, sf))
    out = O.bleak_flags(rows, T.contains_any(F.lower("headline"), ["der", "the"]))
    return out.select("event_id", "noise_quit", "bleak_damped", "bleak_quit")


@query(
    "hook_saturation",
    with_tables(
        """ SELECT event_id, sum((contains(lower(headline), 'er') AND step <= 40)::INT) OVER (PARTITION BY session_id ORDER BY step)::BIGINT AS hook_hits,
  round(greatest(0.55::DOUBLE, 1 - 0.01::DOUBLE * sum((contains(lower(headline), 'er') AND step <= 40)::INT) OVER (PARTITION BY session_id ORDER BY step)), 6) AS saturation
FROM interactions""",
        INTERACTIONS,
    ),
)
def _hook(spark, sf):
    out = O.hook_saturation(X.interactions(spark, sf), F.contains(F.lower("headline"), F.lit("er")), phase=40)
    return out.select("event_id", "hook_hits", R6("saturation"))


@query(
    "session_steps",
    with_tables(
        """,
g AS (SELECT *, sum((dwell < 0.5)::INT) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS visit FROM interaction_events)
SELECT event_id, row_number() OVER (PARTITION BY session_id, coalesce(visit, 0) ORDER BY step) AS session_step FROM g""",
        INTERACTION_EVENTS,
    ),
)
def _session_steps(spark, sf):
    return O.session_steps(log_rows(spark, sf), C("dwell") < 0.5).select("event_id", "session_step")


SQL_FOUR = f"""
four0 AS (SELECT conv_id, turn, role, {sql_sentences('text')} AS p FROM conversations),
four1 AS (SELECT *, list_filter(string_split(replace(p[1], ';', ','), ', '), lambda x: trim(x) <> '') AS cl FROM four0),
four2 AS (SELECT *, CASE WHEN len(p) = 1 AND len(cl) >= 2 THEN list_transform(cl, lambda x: trim(x)) ELSE p END AS q FROM four1),
four AS (SELECT conv_id, turn, role, list_concat(q, [coalesce(q[-1], ''), coalesce(q[-1], ''), coalesce(q[-1], ''), coalesce(q[-1], '')])[1:4] AS parts FROM four2)"""


@query(
    "sentence_memory",
    with_tables(
        """,
s AS (SELECT conv_id, turn, i, parts[i + 1] AS sentence, CASE WHEN turn % 5 = 4 OR i < least(3, turn % 5) THEN 'liked' WHEN i = least(3, turn % 5) THEN 'avoided' END AS kind
      FROM four, (SELECT unnest(range(0, 4)) AS i)),
m AS (SELECT *, list(sentence) OVER (PARTITION BY conv_id, kind ORDER BY turn, i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS memory FROM s WHERE kind IS NOT NULL)
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS position, kind, array_to_string(arg_max(memory, i), '|') AS memory FROM m GROUP BY conv_id, turn, kind""",
        SQL_FOUR,
    ),
)
def _sentence_memory(spark, sf):
    out = O.sentence_memory(X.delivered(spark, sf))
    return out.select("session_id", "position", "kind", F.array_join("memory", "|").alias("memory"))


@query(
    "reader_anchors",
    with_tables(
        """,
a AS (SELECT conv_id, turn, nullif(trim(CASE role WHEN 'user' THEN array_to_string(parts[1:(turn % 4)], ' ') WHEN 'system' THEN array_to_string(parts, ' ') END), '') AS pos,
       nullif(trim(CASE WHEN role = 'user' THEN parts[turn % 4 + 1] END), '') AS neg FROM four)
SELECT CAST(conv_id AS VARCHAR) AS session_id, coalesce(arg_max(pos, turn) FILTER (WHERE pos IS NOT NULL), '') AS pos_anchor,
  coalesce(arg_max(neg, turn) FILTER (WHERE neg IS NOT NULL), '') AS neg_anchor FROM a GROUP BY conv_id""",
        SQL_FOUR,
    ),
)
def _reader_anchors(spark, sf):
    return O.reader_anchors(X.reader_events(spark, sf))


@query(
    "bailout_funnel",
    """
WITH p AS (SELECT CAST(turn % 4 AS INTEGER) AS sentence_index, count(*) FILTER (WHERE role = 'assistant') AS read, count(*) FILTER (WHERE role = 'user') AS skipped
           FROM conversations GROUP BY 1)
SELECT sentence_index, read, skipped, round(sum(skipped) OVER (ORDER BY sentence_index) / (SELECT sum(skipped) FROM p)::DOUBLE, 6) AS reach FROM p""",
)
def _bailout(spark, sf):
    return O.bailout_funnel(X.reader_events(spark, sf)).select("sentence_index", "read", "skipped", R6("reach"))
