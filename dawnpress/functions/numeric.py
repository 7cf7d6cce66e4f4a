"""Rewards, buckets, scores and bonuses as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dawnpress.functions import wordlists as W
from dawnpress.functions.text import bound, contains_any, count_contained, first_words, norm_space, whole_words, word_count


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def hours_between(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(3.6e9)


def recency_bucket(hours: Column) -> Column:
    """0 up to 1 h (and for future dates), 1 up to 6 h, 2 up to 24 h, 3 up to 72 h, else 4."""
    return F.when(hours <= 1, 0).when(hours <= 6, 1).when(hours <= 24, 2).when(hours <= 72, 3).otherwise(4)


def watch_reward(dwell: Column) -> Column:
    return F.lit(-10.0) + clamp(dwell, 0.0, 10.0) * 2.0


def plain_skip_reward(dwell: Column) -> Column:
    return F.lit(-8.0) + clamp(dwell, 0.0, 10.0) * 1.6


def skip_reward(dwell: Column, history: Column, mean: Column, deviation: Column) -> Column:
    """Skip reward against the user's own earlier skips once there are twelve of them."""
    absolute = plain_skip_reward(dwell)
    z = (clamp(dwell, 0.0, 10.0) - mean) / F.greatest(F.lit(0.35), deviation)
    relative = F.tanh(z / 1.35) * 9.0
    return clamp(F.when(history < 12, absolute).otherwise(relative * 0.75 + absolute * 0.25), -10.0, 10.0)


def reward_norm(reward: Column) -> Column:
    return clamp((reward + 10.0) / 20.0, 0.05, 0.95)


def engagement_reward(listen_ms: Column, total_ms: Column, rewinded: Column, shared: Column) -> Column:
    points = (
        listen_ms / total_ms * 8.0
        + F.when(rewinded, 10.0).otherwise(0.0)
        + F.when(shared, 6.0).otherwise(0.0)
        - F.when(listen_ms < 2000.0, 6.0).otherwise(0.0)
    )
    return clamp(points, -10.0, 10.0)


def watch_targets(ratio: Column) -> dict[str, Column]:
    """Six training targets of a watch ratio."""
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    return {
        "finish": flag(ratio >= 0.95),
        "fast_skip": flag(ratio <= 0.20),
        "like": flag(ratio >= 0.85),
        "share": flag(ratio >= 0.95),
        "rewatch": flag(ratio >= 0.90),
        "watch_time": ratio,
    }


def audio_signal(skip_index: Column, listen_ms: Column, total_ms: Column) -> tuple[Column, Column]:
    """(reason, dwell seconds) of an audio feedback event."""
    reason = F.when(skip_index.isNull(), "auto").otherwise("skip")
    measured = F.when(listen_ms.isNotNull() & (total_ms > 0), clamp(listen_ms / total_ms, 0.0, 1.0))
    assumed = F.when(skip_index.isNull(), 1.0).otherwise(0.2)
    return reason, clamp(F.coalesce(measured, assumed) * 10.0, 0.0, 10.0)


def serving_epsilon(step: Column, start: float = 0.18, floor: float = 0.04, decay: float = 220.0) -> Column:
    return F.greatest(F.lit(floor), F.exp(-F.greatest(step, F.lit(0)) / F.lit(decay)) * start)


def training_epsilon(step: Column, total: Column, start: float = 0.25, end: float = 0.10) -> Column:
    progress = clamp(step / F.greatest(total, F.lit(1)), 0.0, 1.0)
    return F.lit(start) + progress * (end - start)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.exp(-c) + 1.0)


def head_score(logits: Mapping[str, Column], weights: Mapping[str, float] = W.SERVING_WEIGHTS) -> Column:
    """Weighted sum of the head probabilities; a predicted fast skip counts against."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        part = sigmoid(logits[name]) * weight
        total = total - part if name == "fast_skip" else total + part
    return total


def positive_signal(logits: Mapping[str, Column]) -> Column:
    return (
        sigmoid(logits["like"]) + sigmoid(logits["share"]) + sigmoid(logits["rewatch"]) - sigmoid(logits["fast_skip"])
    )


def inverse_frequency(documents: Column, frequency: Column) -> Column:
    return F.log((documents + 1) / (frequency + 1)) + 1.0


def damped_count(count: Column) -> Column:
    return F.log(count + 1.0) + 1.0


def dwell_bucket(ratio: Column) -> Column:
    return F.when(ratio < 0.2, 0).when(ratio < 0.5, 1).when(ratio < 0.8, 2).otherwise(3)


def vocabulary_token(raw: Column, size: int = 4096) -> Column:
    prefix = F.conv(F.substring(F.md5(raw), 1, 8), 16, 10).cast("bigint")
    return (prefix % (size - 1) + 1).cast("int")


def event_token(item_id: Column, topic_id: Column, vibe_id: Column, dwell: Column, step: Column) -> Column:
    """Serving token of one interaction."""
    raw = F.format_string(
        "i%d|t%d|v%d|dw%d|sx%d",
        item_id.cast("bigint"),
        topic_id.cast("bigint"),
        vibe_id.cast("bigint"),
        dwell_bucket(clamp(dwell / 10.0, 0.0, 1.0)).cast("bigint"),
        F.least(F.lit(9), F.floor(step / 10)).cast("bigint"),
    )
    return vocabulary_token(raw)


def training_event_token(
    item_id: Column,
    topic_id: Column,
    vibe_id: Column,
    listen_ms: Column,
    total_ms: Column,
    flags: Mapping[str, Column],
    step: Column,
    user_tag: Column,
) -> Column:
    """Training token: also action flags (fast_skip, rewinded, shared, liked, commented), time of day and user."""
    number = lambda c: c.cast("int").cast("string")
    pieces = [
        F.concat(F.lit("i"), item_id.cast("string")),
        F.concat(F.lit("t"), topic_id.cast("string")),
        F.concat(F.lit("v"), vibe_id.cast("string")),
        F.concat(F.lit("dw"), number(dwell_bucket(listen_ms / total_ms))),
        *[
            F.concat(F.lit(code), number(flags[name]))
            for code, name in (
                ("fs", "fast_skip"),
                ("rw", "rewinded"),
                ("sh", "shared"),
                ("lk", "liked"),
                ("cm", "commented"),
            )
        ],
        F.concat(F.lit("tod"), number(step % 4)),
        F.concat(F.lit("sx"), number(F.least(F.lit(9), F.floor(step / 10)))),
        F.concat(F.lit("uid"), user_tag),
        F.lit("dev0"),
        F.lit("geo0"),
    ]
    return vocabulary_token(F.concat_ws("|", *pieces))


def interest_bonus(haystack: Column, hay_tokens: Column, phrases: Column, tokens: Column, weight: float = 0.30) -> Column:
    token_hits = F.size(F.array_intersect(hay_tokens, tokens))
    phrase_hits = F.size(F.filter(phrases, lambda p: F.contains(haystack, p)))
    return hits_bonus(token_hits, phrase_hits, weight)


def hits_bonus(token_hits: Column, phrase_hits: Column, weight: float = 0.30) -> Column:
    """Bonus of the interests found in a text: single words, and up to three phrases."""
    raw = token_hits * 0.22 + F.least(F.lit(3), phrase_hits) * 0.45
    return F.least(F.lit(1.0), raw) * weight


def freshness(recency: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(4.0) - recency) / 4.0


def depth(summary: Column, style: Column) -> Column:
    """Length of the summary against 55 words; reflective styles count as deep."""
    reflective = contains_any(F.lower(F.coalesce(style, F.lit(""))), ["analytical", "deep"])
    return bound(
        F.least(F.lit(1.0), word_count(first_words(summary, 55)) / 55.0), lambda words: F.when(reflective, F.greatest(words, F.lit(0.8))).otherwise(words)
    )


# Words of short and long trips.
SHORT_TRIPS = ["short", "quick", "brief", "under_15", "<15"]
LONG_TRIPS = ["long", "extended", "30", "over_30", "train"]


def commute_bonus(commute: Column, fresh: Column, deep: Column, weight: float = 0.08) -> Column:
    """Short trips favour fresh items, long trips favour depth, anything else the mean of both."""
    low = F.lower(F.coalesce(commute, F.lit("")))
    short, long = contains_any(low, SHORT_TRIPS), contains_any(low, LONG_TRIPS)
    return (
        F.when(low == "", 0.0)
        .when(short, fresh * weight)
        .when(long, deep * weight)
        .otherwise((fresh * 0.5 + deep * 0.5) * weight)
    )


def cluster_bucket(category: Column, headline_and_entities: Column, ai_words: Sequence[str] = W.AI_BUCKET_WORDS) -> Column:
    about_ai = F.rlike(F.lower(headline_and_entities), F.lit(whole_words(ai_words)))
    return (
        F.when((category == "tech") & about_ai, "ai")
        .when(category == "business", "markets")
        .when(category == "politics", "policy")
        .when(category == "tech", "tech_industry")
        .otherwise(category)
    )


def cluster_score(size: Column, sources: Column, cohesion: Column, age_days: Column) -> Column:
    recency = F.exp(-F.greatest(F.lit(0.0), age_days) / 5.0)
    return size * 1.3 + sources * 1.4 + F.greatest(F.lit(0.0), cohesion) * 7.5 + recency * 8.0


def quartile_bucket(rank: Column, rows: Column) -> Column:
    """Quartile 0-3 of a 1-based rank with the interpolated edges of a quantile cut."""
    edge = F.ceil((rank - 1) * 4 / F.greatest(rows - 1, F.lit(1)))
    return (F.greatest(edge, F.lit(1)) - 1).cast("int")


def keyword_hits(text: Column, words: list[str]) -> Column:
    return count_contained(F.lower(norm_space(text)), words)
