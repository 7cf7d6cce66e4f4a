"""Session history as window frames over the interaction log.

Frames are evaluated with the helpers of ``frames``: a session (or run) of any length is spread over partitions of
bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnpress.functions import numeric as N
from dawnpress.functions import text as T
from dawnpress.operators.frames import rolling, running, running_max, sequence_number, top_per_key

SKIP_HISTORY = 240
SEQUENCE = 30
SEEN = 60
STEP_CHUNK = 4096


def _chunk(seq: str) -> Column:
    return F.floor(F.col(seq) / STEP_CHUNK)


def adaptive_rewards(log: DataFrame, keys: Sequence[str] = ("session_id",), step: str = "step") -> DataFrame:
    """Reward per interaction: finished 10, skips against the session's earlier skips, anything else by dwell."""
    keys = list(keys)
    skips = sequence_number(log.where("reason = 'skip'"), keys, [step], _chunk(step), "_n")
    before = lambda w: w.rowsBetween(-SKIP_HISTORY, -1)
    judged = rolling(
        skips,
        keys,
        "_n",
        SKIP_HISTORY,
        {
            "_count": lambda w: F.count("dwell").over(before(w)),
            "_mean": lambda w: F.avg("dwell").over(before(w)),
            "_dev": lambda w: F.stddev_pop("dwell").over(before(w)),
        },
    )
    reward = N.skip_reward(F.col("dwell"), F.col("_count"), F.col("_mean"), F.col("_dev"))
    skipped = judged.withColumn("session_reward", reward).drop("_n", "_count", "_mean", "_dev")
    others = log.where("reason <> 'skip'").withColumn(
        "session_reward", F.when(F.col("reason") == "auto", 10.0).otherwise(N.watch_reward(F.col("dwell")))
    )
    return skipped.unionByName(others.select(skipped.columns))


def running_mean(log: DataFrame, value: str, name: str, keys: Sequence[str] = ("session_id",), step: str = "step") -> DataFrame:
    summed = running(log, list(keys), step, {"_sum": F.col(value), "_rows": F.lit(1)})
    return summed.withColumn(name, F.col("_sum") / F.col("_rows")).drop("_sum", "_rows")


def event_sequences(log: DataFrame, token: str, after: bool = True, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Last thirty tokens per row, left-padded with 0; ``after=False`` gives the sequence before the event."""
    frame = (-(SEQUENCE - 1), 0) if after else (-SEQUENCE, -1)
    out = rolling(
        log, list(keys), "step", SEQUENCE, {"event_seq": lambda w: F.collect_list(token).over(w.rowsBetween(*frame))}
    )
    pad = F.array_repeat(F.lit(0), F.lit(SEQUENCE) - F.size("event_seq"))
    return out.withColumn("event_seq", F.concat(pad, "event_seq"))


def recently_seen(log: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    return rolling(
        log, list(keys), "step", SEEN, {"recent_seen": lambda w: F.collect_list("item_id").over(w.rowsBetween(-SEEN, -1))}
    )


def latest_seen(log: DataFrame, window: int = SEEN) -> DataFrame:
    """The last ``window`` interactions of each session, newest first in ``seen_rank``."""
    return top_per_key(log, ["session_id"], [F.desc("step")], window, "seen_rank")


def exposure(seen: DataFrame, column: str) -> DataFrame:
    return seen.groupBy("session_id", column).agg(F.count(F.lit(1)).alias("exposures"))


def streak_topic(seen: DataFrame, length: int = 5) -> DataFrame:
    """Topic of the last five interactions where all five agree."""
    last = seen.where(F.col("seen_rank") <= length)
    agreed = last.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("topic_id").alias("streak_topic"), F.max("topic_id").alias("_max")
    )
    return agreed.where((F.col("_n") == length) & (F.col("streak_topic") == F.col("_max"))).select(
        "session_id", "streak_topic"
    )


def topic_streaks(log: DataFrame, keys: Sequence[str] = ("session_id",), length: int = 5) -> DataFrame:
    """Per row: did the previous five interactions share one topic?"""
    frame = lambda w: w.rowsBetween(-length, -1)
    out = rolling(
        log,
        list(keys),
        "step",
        length,
        {
            "_n": lambda w: F.count("topic_id").over(frame(w)),
            "_lo": lambda w: F.min("topic_id").over(frame(w)),
            "_hi": lambda w: F.max("topic_id").over(frame(w)),
        },
    )
    return out.withColumn("same_topic_streak", (F.col("_n") == length) & F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(False))).drop(
        "_n", "_lo", "_hi"
    )


def rolling_rewards(log: DataFrame, keys: Sequence[str], seq: str, value: str = "reward") -> DataFrame:
    """Mean of the last 5 and of the last 50 rewards, the row included."""
    return rolling(
        log,
        list(keys),
        seq,
        49,
        {
            "avg_5": lambda w: F.avg(value).over(w.rowsBetween(-4, 0)),
            "avg_50": lambda w: F.avg(value).over(w.rowsBetween(-49, 0)),
        },
    )


def panic_epsilon(log: DataFrame, total_steps: Column, seq: str = "step", panic: float = 0.35) -> DataFrame:
    """Exploration rate per user step: raised while the mean of the previous five rewards (of more than five) is negative."""
    out = rolling(
        log, ["session_id"], seq, 5, {"_mean": lambda w: F.avg("reward").over(w.rowsBetween(-5, -1))}
    )
    unhappy = (F.col(seq) > 6) & (F.col("_mean") < 0)
    return out.withColumn(
        "epsilon", F.when(unhappy, panic).otherwise(N.training_epsilon(F.col(seq), total_steps))
    ).drop("_mean")


def recovery_mode(
    log: DataFrame, keys: Sequence[str], seq: str, threshold: float = 0.0, patience: int = 20
) -> DataFrame:
    """Consecutive steps whose previous fifty rewards average below the threshold, and whether that exceeds patience."""
    keys = list(keys)
    judged = rolling(
        log,
        keys,
        seq,
        50,
        {
            "_n": lambda w: F.count("reward").over(w.rowsBetween(-50, -1)),
            "_mean": lambda w: F.avg("reward").over(w.rowsBetween(-50, -1)),
        },
    )
    low = (F.col("_n") == 50) & (F.col("_mean") < threshold)
    marked = judged.withColumn("_low", F.coalesce(low, F.lit(False)))
    broken = running_max(marked, keys, seq, "_break", F.when(~F.col("_low"), F.col(seq)))
    streak = F.col(seq) - F.coalesce(F.col("_break"), F.lit(0))
    return (
        broken.withColumn("low_streak", streak)
        .withColumn("recovery", streak > patience)
        .drop("_n", "_mean", "_low", "_break")
    )


def bad_domains_as_of(log: DataFrame, min_rows: int = 4, threshold: float = -3.0, memory: int = 12) -> DataFrame:
    """Per row: was its source bad for the session, judged by the last twelve earlier rewards from it?"""
    keys = ["session_id", "topic_id"]
    numbered = sequence_number(log, keys, ["step"], _chunk("step"), "_n")
    out = rolling(
        numbered,
        keys,
        "_n",
        memory,
        {
            "_rows": lambda w: F.count("reward").over(w.rowsBetween(-memory, -1)),
            "_mean": lambda w: F.avg("reward").over(w.rowsBetween(-memory, -1)),
        },
    )
    bad = (F.col("_rows") >= min_rows) & (F.col("_mean") <= threshold)
    return out.withColumn("bad_domain", F.coalesce(bad, F.lit(False))).drop("_n", "_rows", "_mean")


def bad_domains(log: DataFrame, min_rows: int = 4, threshold: float = -3.0, memory: int = 12) -> DataFrame:
    """Sources whose last twelve rewards in the session average at or below the threshold."""
    last = top_per_key(log, ["session_id", "topic_id"], [F.desc("step")], memory, "_rank")
    stats = last.groupBy("session_id", "topic_id").agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"))
    return stats.where((F.col("n") >= min_rows) & (F.col("mean_reward") <= threshold))


def noise_flags(log: DataFrame, noisy_words: Sequence[str] = ("angry", "rant", "sarcastic", "clickbait")) -> DataFrame:
    """Five styles seen, more than two of them noisy."""
    noisy = T.contains_any(F.lower("vibe_style"), list(noisy_words)).cast("int")
    out = rolling(
        log.withColumn("_noisy", noisy),
        ["session_id"],
        "step",
        4,
        {
            "_n": lambda w: F.count("_noisy").over(w.rowsBetween(-4, 0)),
            "_sum": lambda w: F.sum("_noisy").over(w.rowsBetween(-4, 0)),
        },
    )
    return out.withColumn("noise_quit", (F.col("_n") == 5) & (F.col("_sum") > 2)).drop("_noisy", "_n", "_sum")


def bleak_flags(log: DataFrame, bleak: Column) -> DataFrame:
    """Damping after three bleak items among the previous eight; quit risk at six of the last eight."""
    out = rolling(
        log.withColumn("_bleak", bleak.cast("int")),
        ["session_id"],
        "step",
        8,
        {
            "_before": lambda w: F.sum("_bleak").over(w.rowsBetween(-8, -1)),
            "_n": lambda w: F.count("_bleak").over(w.rowsBetween(-7, 0)),
            "_sum": lambda w: F.sum("_bleak").over(w.rowsBetween(-7, 0)),
        },
    )
    return (
        out.withColumn("bleak_damped", (F.col("_bleak") == 1) & (F.coalesce("_before", F.lit(0)) >= 3))
        .withColumn("bleak_quit", (F.col("_n") == 8) & (F.col("_sum") >= 6))
        .drop("_bleak", "_before", "_n", "_sum")
    )


def hook_saturation(log: DataFrame, hook: Column, phase: int = 100) -> DataFrame:
    """Wear-out factor of a hook: one per cent less for every hit of the first phase, not below 0.55."""
    counted = hook & (F.col("step") <= phase)
    out = running(log, ["session_id"], "step", {"hook_hits": counted.cast("int")})
    return out.withColumn("saturation", F.greatest(F.lit(0.55), F.lit(1.0) - F.col("hook_hits") * 0.01))


def session_steps(log: DataFrame, quit: Column, seq: str = "step") -> DataFrame:
    """Step inside the visit: numbering restarts after a row that ended the session."""
    marked = rolling(
        log.withColumn("_quit", quit), ["session_id"], seq, 1, {"_after": lambda w: F.lag("_quit").over(w)}
    )
    started = running_max(marked, ["session_id"], seq, "_start", F.when(F.coalesce("_after", F.lit(True)), F.col(seq)))
    return started.withColumn("session_step", F.col(seq) - F.col("_start") + 1).drop("_quit", "_after", "_start")


def feedback_sentences(feedback: DataFrame) -> DataFrame:
    """(session_id, position, place, kind, sentence): sentences before the skip are liked, the skipped one avoided."""
    at = F.greatest(F.lit(0), F.least(F.lit(3), F.col("skip_index")))
    kind = (
        F.when(F.col("skip_index").isNull() | (F.col("place") < at), "liked").when(F.col("place") == at, "avoided")
    )
    spread = feedback.select("session_id", "position", "skip_index", F.posexplode("sentences").alias("place", "sentence"))
    return spread.withColumn("kind", kind).where("kind is not null").drop("skip_index")


def sentence_memory(feedback: DataFrame, size: int = 5) -> DataFrame:
    """Memory after each feedback event that changed it: the last five liked or avoided sentences."""
    keys = ["session_id", "kind"]
    rows = sequence_number(
        feedback_sentences(feedback), keys, ["position", "place"], F.floor(F.col("position") / STEP_CHUNK), "_n"
    )
    out = rolling(
        rows, keys, "_n", size - 1,
        {"memory": lambda w: F.collect_list("sentence").over(w.rowsBetween(-(size - 1), 0))},
    )
    return out.groupBy("session_id", "position", "kind").agg(F.max_by("memory", "_n").alias("memory"))


def reader_anchors(events: DataFrame) -> DataFrame:
    """Last non-empty liked and avoided text of each reader session."""
    at = F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce("sentence_index", F.lit(0))))
    skipped, done = F.col("action") == "skip_article", F.col("action") == "complete_article"
    read = F.when(skipped, F.slice("sentences", F.lit(1), at)).when(done, F.col("sentences"))
    liked = T.blank_to_null(T.strip(F.array_join(read, " ")))
    avoided = T.blank_to_null(T.strip(F.when(skipped, F.get("sentences", at))))
    marked = events.select("session_id", "position", liked.alias("_pos"), avoided.alias("_neg"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("position")))
    return marked.groupBy("session_id").agg(
        F.coalesce(last("_pos"), F.lit("")).alias("pos_anchor"), F.coalesce(last("_neg"), F.lit("")).alias("neg_anchor")
    )


def bailout_funnel(events: DataFrame) -> DataFrame:
    """Reads and bail-outs per sentence, and the share of all bail-outs up to it."""
    per = events.where("sentence_index is not null").groupBy("sentence_index").agg(
        F.count_if(F.col("action") == "read_sentence").alias("read"),
        F.count_if(F.col("action") == "skip_article").alias("skipped"),
    )
    # At most four sentence positions remain here.
    upto = Window.orderBy("sentence_index").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("skipped").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("reach", F.sum("skipped").over(upto) / F.greatest(total, F.lit(1)))
