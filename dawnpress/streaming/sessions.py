"""Live session state: interactions, audio feedback and reader events as keyed streams.

State is partitioned by session and holds bounded histories only. Each machine has a batch twin in
``operators.windows`` or below, which tests and queries compare it with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dawnpress.functions import numeric as N
from dawnpress.functions import wordlists as W
from dawnpress.operators.frames import first_per_key, running_max, sequence_number
from dawnpress.operators.windows import SEEN, SEQUENCE, SKIP_HISTORY, adaptive_rewards, sentence_memory
from dawnpress.session import cut_lineage

HEADS = ["finish", "like", "share", "rewatch", "fast_skip", "watch_time"]
# Loss weights of the private update.
LOSS = {"finish": 0.8, "fast_skip": 0.6, "like": 0.5, "share": 0.4, "rewatch": 0.4, "watch_time": 1.5, "rank": 1.0}
LEARNING_RATE, GRADIENT_CLIP, DELTA_NORM = 0.03, 5.0, 4.0

# --- idempotent ingest -----------------------------------------------------------------------------------------------


def has_usable_id(event_id: Column) -> Column:
    return F.coalesce((event_id != "") & (F.length(event_id) <= 128), F.lit(False))


def dedupe_stream(events: DataFrame, ttl: str = "14 days", ts: str = "ts") -> DataFrame:
    """Drop repeated (uid, session_id, event_id) within the time to live; rows without a usable id pass."""
    usable = has_usable_id(F.col("event_id"))
    timed = events.withWatermark(ts, ttl)
    unique = timed.where(usable).dropDuplicatesWithinWatermark(["uid", "session_id", "event_id"])
    return unique.unionByName(timed.where(~usable))


def dedupe_batch(events: DataFrame, ttl_days: int = 14, ts: str = "ts") -> DataFrame:
    """Batch twin: an event counts again once ``ttl_days`` have passed since the last one that counted.

    Every round accepts the first event of each key and drops what follows within the time to live, so there are as many rounds as
    the log has times to live; a key with many repeats is cut to one row per task before each shuffle.
    """
    keys = ["uid", "session_id", "event_id"]
    usable = has_usable_id(F.col("event_id"))
    accepted, rest = events.where(~usable), cut_lineage(events.where(usable))
    while not rest.isEmpty():
        first = cut_lineage(first_per_key(rest, keys, [ts]))
        accepted = accepted.unionByName(first)
        until = F.expr(f"make_dt_interval({ttl_days}, 0, 0, 0)")
        ends = first.select(*keys, (F.col(ts) + until).alias("_until"))
        rest = cut_lineage(rest.join(ends, keys).where(F.col(ts) >= F.col("_until")).drop("_until"))
    return accepted


# --- interactions ----------------------------------------------------------------------------------------------------

INTERACTION_STATE = (
    "step bigint, event_seq array<int>, recent_seen array<bigint>, skips array<double>, avg_reward double, delta array<double>"
)
INTERACTION_OUTPUT = (
    "event_id bigint, session_id string, step bigint, reward double, avg_reward double, event_seq array<int>, "
    "recent_seen array<bigint>, delta_norm double"
)


def skip_reward_of(dwell: float, history: list[float]) -> float:
    absolute = -8.0 + 1.6 * dwell
    if len(history) < 12:
        return min(10.0, max(-10.0, absolute))
    mean = math.fsum(history) / len(history)
    spread = math.sqrt(math.fsum([(x - mean) ** 2 for x in history]) / len(history))
    z = (dwell - mean) / max(0.35, spread)
    return min(10.0, max(-10.0, 0.75 * 9.0 * math.tanh(z / 1.35) + 0.25 * absolute))


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x > -700.0 else 0.0


SIGNED_WEIGHTS = [W.SERVING_WEIGHTS[h] * (-1 if h == "fast_skip" else 1) for h in HEADS]


def preference_pull(z: float, ratio: float, reward: float, heads: list[tuple[float, float]]) -> float:
    """Slope of the private loss along the item's vector, at ``z`` = (base + delta) * item."""
    targets = (ratio >= 0.95, ratio >= 0.85, ratio >= 0.95, ratio >= 0.90, ratio <= 0.20)
    probability = [_sigmoid(scale * z + bias) for scale, bias in heads]
    slope = [p * (1 - p) * scale for p, (scale, _) in zip(probability, heads, strict=True)]
    pull = 0.0
    for head, p, target, (scale, _) in zip(HEADS, probability, targets, heads):  # noqa: B905 - watch time has no target
        pull += LOSS[head] * (p - target) * scale
    pull += LOSS["watch_time"] * 2 * (probability[5] - ratio) * slope[5]
    ranked = _sigmoid(sum(w * p for w, p in zip(SIGNED_WEIGHTS, probability, strict=True)))
    wanted = min(0.95, max(0.05, (reward + 10.0) / 20.0))
    tilt = sum(w * t for w, t in zip(SIGNED_WEIGHTS, slope, strict=True))
    return pull + LOSS["rank"] * 2 * (ranked - wanted) * ranked * (1 - ranked) * tilt


def preference_step(
    delta: np.ndarray, base: np.ndarray, item: np.ndarray, ratio: float, reward: float, heads: np.ndarray | list[tuple[float, float]]
) -> np.ndarray:
    """One private gradient step of the session's vector under linear heads ``scale * dot + bias`` (rows of ``heads``)."""
    pairs = heads.tolist() if isinstance(heads, np.ndarray) else heads
    pull = preference_pull(float((base + delta) @ item), ratio, reward, pairs)
    size = abs(pull) * math.sqrt(item @ item)
    if size > GRADIENT_CLIP:
        pull *= GRADIENT_CLIP / (size + 1e-8)
    moved = delta - (LEARNING_RATE * pull) * item
    length = math.sqrt(moved @ moved)
    return moved * (DELTA_NORM / (length + 1e-8)) if length > DELTA_NORM else moved


def interaction_stream(
    events: DataFrame, heads: list[tuple[float, float]] | None = None, expire_minutes: int | None = None
) -> DataFrame:
    """Session machine over (session_id, event_id, ts, item_id, token columns, reason, dwell, vec, optional base).

    ``base`` is the session's own vector, to which the private preference is added; without it the step starts from zero.

    ``token`` is the vocabulary number of an event at a given step, so it is computed from columns before the state and
    only its step part is added inside: the stream carries ``token_head``, the text before the step bucket.
    """
    import hashlib

    weights = [(float(scale), float(bias)) for scale, bias in heads or [(1.0, 0.0)] * len(HEADS)]
    has_base = "base" in events.columns
    used = ["event_id", "item_id", "dwell", "reason", "vec", "token_head", *(["base"] if has_base else [])]

    def machine(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            step, seq, seen, skips, mean, delta = state.get
            seq, seen, skips, delta = list(seq), list(seen), list(skips), np.asarray(delta, float)
        else:
            step, seq, seen, skips, mean, delta = 0, [0] * SEQUENCE, [], [], 0.0, np.zeros(0)
        parts = list(batches)
        rows = (parts[0] if len(parts) == 1 else pd.concat(parts)).sort_values(["ts", "event_id"])
        out = []
        for event_id, item_id, watched, reason, vec, token_head, *own in zip(*[rows[c].tolist() for c in used], strict=True):
            dwell = min(10.0, max(0.0, watched))
            if reason == "auto":
                reward = 10.0
            else:
                reward = skip_reward_of(dwell, skips) if reason == "skip" else -10.0 + 2.0 * dwell
            vec = np.asarray(vec, float) if vec is not None else np.zeros(0)
            if len(vec):
                delta = delta if len(delta) == len(vec) else np.zeros(len(vec))
                known = has_base and own[0] is not None and len(own[0]) == len(vec)
                base = np.asarray(own[0], float) if known else np.zeros(len(vec))
                delta = preference_step(delta, base, vec, dwell / 10.0, reward, weights)
            before = seen
            step += 1
            seen = [*seen, int(item_id)][-SEEN:]
            if reason == "skip":
                skips = [*skips, dwell][-SKIP_HISTORY:]
            mean += (reward - mean) / step
            digest = hashlib.md5(f"{token_head}|sx{min(9, step // 10)}".encode()).hexdigest()
            seq = [*seq, 1 + int(digest[:8], 16) % 4095][-SEQUENCE:]
            out.append((event_id, key[0], step, reward, mean, seq, before, math.sqrt(delta @ delta)))
        state.update((step, seq, seen, skips, float(mean), [float(x) for x in delta]))
        if expire_minutes is not None:
            state.setTimeoutDuration(expire_minutes * 60_000)
        yield pd.DataFrame(
            out, columns=["event_id", "session_id", "step", "reward", "avg_reward", "event_seq", "recent_seen", "delta_norm"]
        )

    timeout = GroupStateTimeout.NoTimeout if expire_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("session_id").applyInPandasWithState(
        machine, INTERACTION_OUTPUT, INTERACTION_STATE, "append", timeout
    )


def token_head(item_id: Column, topic_id: Column, vibe_id: Column, dwell: Column) -> Column:
    bucket = N.dwell_bucket(N.clamp(dwell / 10.0, 0.0, 1.0))
    return F.concat(
        F.lit("i"), item_id.cast("string"), F.lit("|t"), topic_id.cast("string"), F.lit("|v"), vibe_id.cast("string"),
        F.lit("|dw"), bucket.cast("string"),
    )


# --- audio feedback --------------------------------------------------------------------------------------------------

AUDIO_STATE = "content_id string, item_id bigint, sentences array<string>, consumed boolean, liked array<string>, avoided array<string>, skips array<double>"
AUDIO_OUTPUT = (
    "session_id string, at bigint, content_id string, status string, item_id bigint, reason string, reward double, "
    "liked array<string>, avoided array<string>"
)


def audio_stream(messages: DataFrame, expire_minutes: int | None = None) -> DataFrame:
    """Deliveries and feedback of a session in order of ``at``: feedback counts once and only for the pending content.

    ``messages`` is (session_id, at, kind, content_id, item_id, sentences, skip_index, reason, dwell).
    """

    def machine(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current = list(state.get) if state.exists else [None, None, [], False, [], [], []]
        out = []
        for r in pd.concat(list(batches)).sort_values("at").itertuples(index=False):
            if r.kind == "delivered":
                current[:4] = [r.content_id, int(r.item_id), [s for s in r.sentences if s.strip()][:4], False]
                continue
            status, reward = "ok", None
            if current[0] != r.content_id:
                status = "mismatch"
            elif current[3]:
                status = "duplicate"
            elif len(current[2]) != 4:
                status = "malformed"
            else:
                sentences = list(current[2])
                if pd.isna(r.skip_index):
                    reward = 10.0
                    current[4] = [*current[4], *sentences][-5:]
                else:
                    at = min(3, max(0, int(r.skip_index)))
                    reward = skip_reward_of(r.dwell, list(current[6]))
                    current[6] = [*current[6], r.dwell][-SKIP_HISTORY:]
                    current[4] = [*current[4], *sentences[:at]][-5:]
                    current[5] = [*current[5], sentences[at]][-5:]
                current[3] = True
            fine = status == "ok"
            out.append(
                (key[0], r.at, r.content_id, status, current[1] if fine else None, r.reason if fine else None, reward,
                 list(current[4]) if fine else None, list(current[5]) if fine else None)
            )
        state.update(tuple(current))
        if expire_minutes is not None:
            state.setTimeoutDuration(expire_minutes * 60_000)
        columns = ["session_id", "at", "content_id", "status", "item_id", "reason", "reward", "liked", "avoided"]
        frame = pd.DataFrame(out, columns=columns)
        frame["item_id"] = frame["item_id"].astype("Int64")
        yield frame

    timeout = GroupStateTimeout.NoTimeout if expire_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    return messages.groupBy("session_id").applyInPandasWithState(machine, AUDIO_OUTPUT, AUDIO_STATE, "append", timeout)


def audio_batch(messages: DataFrame) -> DataFrame:
    """Batch twin: status, reason and reward of every feedback message."""
    numbered = sequence_number(messages, ["session_id"], ["at"], F.floor(F.col("at") / 4096), "n")
    pending = running_max(numbered, ["session_id"], "n", "pending", F.when(F.col("kind") == "delivered", F.col("n")))
    given = numbered.where("kind = 'delivered'").select(
        "session_id", F.col("n").alias("pending"), F.col("content_id").alias("given_id"), F.col("item_id").alias("given_item"),
        F.col("sentences").alias("given_sentences"),
    )
    feedback = pending.where("kind = 'feedback'").join(given, ["session_id", "pending"], "left")
    matching = F.coalesce(F.col("content_id") == F.col("given_id"), F.lit(False))
    whole = F.size(F.filter("given_sentences", lambda s: F.trim(s) != "")) == 4
    judged = feedback.withColumn("status", F.when(~matching, "mismatch").when(~whole, "malformed").otherwise("ok"))
    first = first_per_key(judged.where("status = 'ok'"), ["session_id", "pending"], ["n"]).select("session_id", "n", F.lit(1).alias("first"))
    marked = judged.join(first, ["session_id", "n"], "left").withColumn(
        "status", F.when((F.col("status") == "ok") & F.col("first").isNull(), "duplicate").otherwise(F.col("status"))
    )
    accepted = marked.where("status = 'ok'").withColumn("step", F.col("n"))
    rewarded = adaptive_rewards(accepted).select("session_id", "n", F.col("session_reward").alias("reward"))
    return marked.join(rewarded, ["session_id", "n"], "left").select(
        "session_id", "at", "content_id", "status", F.when(F.col("status") == "ok", F.col("reason")).alias("reason"), "reward",
        "given_sentences", "skip_index",
    )


def audio_memory(judged: DataFrame) -> DataFrame:
    """Sentence memory after each accepted feedback."""
    accepted = judged.where("status = 'ok'").select(
        "session_id", F.col("at").alias("position"), F.col("given_sentences").alias("sentences"), "skip_index"
    )
    return sentence_memory(accepted)


# --- reader sessions -------------------------------------------------------------------------------------------------

READER_STATE = "seen array<bigint>, pos_anchor string, neg_anchor string"
READER_OUTPUT = "session_id string, position bigint, seen int, pos_anchor string, neg_anchor string"


def reader_stream(events: DataFrame, memory: int | None = None, expire_minutes: int | None = None) -> DataFrame:
    """Reader sessions: articles seen and the last liked and avoided texts after each event.

    ``events`` is (session_id, position, article_id, action, sentence_index, sentences). ``memory`` is an explicit request
    to remember no more than so many articles; ``expire_minutes`` ends the state of sessions without events.
    """

    def machine(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, liked, avoided = state.get if state.exists else ([], "", "")
        seen = list(seen)
        known = set(seen)
        out = []
        for r in pd.concat(list(batches)).sort_values("position").itertuples(index=False):
            if r.article_id not in known:
                seen.append(int(r.article_id))
                known.add(seen[-1])
                if memory and len(seen) > memory:
                    known.discard(seen.pop(0))
            if r.action == "skip_article":
                at = min(3, max(0, 0 if pd.isna(r.sentence_index) else int(r.sentence_index)))
                liked = " ".join(r.sentences[:at]).strip() or liked
                avoided = (str(r.sentences[at]).strip() if at < len(r.sentences) else "") or avoided
            elif r.action == "complete_article":
                liked = " ".join(r.sentences).strip() or liked
            out.append((key[0], r.position, len(seen), liked, avoided))
        state.update((seen, liked, avoided))
        if expire_minutes is not None:
            state.setTimeoutDuration(expire_minutes * 60_000)
        yield pd.DataFrame(out, columns=["session_id", "position", "seen", "pos_anchor", "neg_anchor"])

    timeout = GroupStateTimeout.NoTimeout if expire_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("session_id").applyInPandasWithState(machine, READER_OUTPUT, READER_STATE, "append", timeout)
