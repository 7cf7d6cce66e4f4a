"""Evaluation roll-ups: sessions, segments, regret, hard negatives, model parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnpress.functions import numeric as N
from dawnpress.functions import text as T
from dawnpress.operators.frames import top_per_key

METRICS = ["steps", "avg_reward", "auto_rate", "skip_rate", "avg_watch_ratio"]


def select_segments(rows: DataFrame, wanted: str, valid: Sequence[str], column: str = "persona") -> DataFrame:
    """Rows of the named segments (``all`` or a comma list); an unknown name is an error."""
    if wanted.strip().lower() == "all":
        return rows.where(F.col(column).isin(list(valid)))
    names = [n.strip() for n in wanted.split(",") if n.strip()]
    unknown = [n for n in names if n not in valid]
    if unknown:
        raise ValueError(f"unknown segments {unknown}; valid: {list(valid)}")
    return rows.where(F.col(column).isin(names))


def session_metrics(runs: DataFrame) -> DataFrame:
    """Per (condition, persona, session): steps, mean reward, share of finished and skipped items, mean watch ratio."""
    rate = lambda kind: F.avg(F.when(F.col("reason") == kind, 1.0).otherwise(0.0))
    return runs.groupBy("condition", "persona", "session_id").agg(
        F.count(F.lit(1)).cast("double").alias("steps"),
        F.avg("reward").alias("avg_reward"),
        rate("auto").alias("auto_rate"),
        rate("skip").alias("skip_rate"),
        F.avg(N.clamp(F.col("interest"), 0.0, 1.0)).alias("avg_watch_ratio"),
    )


def persona_metrics(sessions: DataFrame) -> DataFrame:
    """Means over sessions per (condition, persona)."""
    names = {"steps": "avg_steps"}
    return sessions.groupBy("condition", "persona").agg(
        F.count(F.lit(1)).cast("double").alias("sessions"), *[F.avg(m).alias(names.get(m, m)) for m in METRICS]
    )


def condition_metrics(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("condition").agg(
        F.avg("avg_reward").alias("avg_reward_over_sessions"), F.avg("steps").alias("avg_steps_over_sessions")
    )


def compare_conditions(personas: DataFrame, first: str, second: str, metric: str = "avg_reward") -> DataFrame:
    """Two conditions side by side per persona, with their difference."""
    wide = personas.groupBy("persona").pivot("condition", [first, second]).agg(F.first(metric))
    return wide.withColumn("delta", F.col(f"`{second}`") - F.col(f"`{first}`"))


def run_summary(runs: DataFrame, keys: list[str], step: str = "step", last: int = 10) -> DataFrame:
    """Mean of the last rewards and mean regret (nulls skipped, 0 without any) per run."""
    tail = top_per_key(runs, keys, [F.desc(step)], last, "_rank").groupBy(*keys).agg(F.avg("reward").alias("final_reward"))
    whole = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("interactions"), F.coalesce(F.avg("regret"), F.lit(0.0)).alias("mean_regret")
    )
    return whole.join(tail, keys)


def counterfactual_regret(
    candidates: DataFrame, chosen: Column, keys: Sequence[str] = ("session_id", "step"), sample: int | None = None
) -> DataFrame:
    """Best reward among the alternatives of a decision minus the reward of the chosen one.

    ``sample`` limits the alternatives to that many per decision in hash order, as a sampling estimate.
    """
    rows = candidates.withColumn("_chosen", chosen)
    if sample is not None:
        rows = top_per_key(rows, [*keys], [F.desc("_chosen"), F.xxhash64(*keys, "item_id")], sample, "_rank")
    return rows.groupBy(*keys).agg(
        (F.max("reward") - F.max(F.when(F.col("_chosen"), F.col("reward")))).alias("regret")
    )


def hard_negatives(
    candidates: DataFrame,
    chosen: Column,
    keys: Sequence[str] = ("session_id", "step"),
    pool: int = 64,
    confidence: float = 0.60,
) -> DataFrame:
    """Most confident candidate of a decision that the reader would have disliked."""
    top = top_per_key(candidates.withColumn("_chosen", chosen), [*keys], [F.desc("score"), F.asc("item_id")], pool, "_rank")
    disliked = top.where(~F.col("_chosen") & (F.col("reward") < 0))
    best = disliked.groupBy(*keys).agg(
        F.min_by("item_id", "_rank").alias("item_id"),
        N.sigmoid(F.max("score")).alias("confidence"),
        F.min_by("reward", "_rank").alias("reward"),
    )
    return best.where(F.col("confidence") >= confidence)


def replay_positives(log: DataFrame, threshold: float = 4.5, keep: int = 512, order: str = "run_step", keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """The latest ``keep`` well-rewarded rows of each run."""
    return top_per_key(log.where(F.col("reward") >= threshold), list(keys), [F.desc(order)], keep, "replay_rank")


# --- rule segments --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Segment:
    """Reader segment as data: style weights, keyword adjustments in order, reward tiers.

    ``adjustments`` are the tuples that ``segment_score`` reads. ``tiers`` are (above, reward) from high to low,
    ``otherwise`` the last reward.
    """

    weights: Mapping[str, float]
    adjustments: Sequence[tuple] = ()
    tiers: Sequence[tuple[float, float]] = ((1.2, 10.0), (0.8, 3.0))
    otherwise: float = -5.0
    default_weight: float = 1.0


def segment_score(segment: Segment, style: Column, text: Column) -> Column:
    """Style weight times keyword factors.

    Adjustment kinds: ("boost", words, factor), ("lift", words, factor) raises the weight to 1 first, ("unless", words,
    factor, gate words) skips texts that hit the gate, ("either", words, factor, otherwise) has a factor for both cases and
    ("count_or", words, base, per hit, most, otherwise) grows with the number of words found.
    """
    low = F.lower(F.coalesce(style, F.lit("Standard Reporting")))
    score = F.lit(segment.default_weight)
    for name, weight in segment.weights.items():
        score = F.when(low == name, weight).otherwise(score)
    for kind, words, factor, *more in segment.adjustments:
        hit = T.contains_any(text, list(words))
        if kind == "boost":
            score = score * F.when(hit, factor).otherwise(1.0)
        elif kind == "lift":
            score = F.when(hit, F.greatest(score, F.lit(1.0)) * factor).otherwise(score)
        elif kind == "unless":
            score = score * F.when(hit & ~T.contains_any(text, list(more[0])), factor).otherwise(1.0)
        elif kind == "either":
            score = score * F.when(hit, factor).otherwise(more[0])
        elif kind == "count_or":
            per_hit, most, otherwise = more
            grown = F.least(F.lit(most), T.count_contained(text, list(words)) * per_hit) + factor
            score = score * F.when(hit, grown).otherwise(otherwise)
        else:
            raise ValueError(f"unknown adjustment {kind}")
    return score


def tier_reward(segment: Segment, score: Column) -> Column:
    chain = None
    for above, reward in segment.tiers:
        chain = F.when(score > above, reward) if chain is None else chain.when(score > above, reward)
    return chain.otherwise(segment.otherwise)


def segment_rewards(items: DataFrame, segments: Mapping[str, Segment]) -> DataFrame:
    """(item columns, segment, score, reward) for every item and stateless segment."""
    text = F.lower(F.concat_ws(" ", T.text_or_empty(F.col("headline")), T.text_or_empty(F.col("topic_name"))))
    entries = []
    for name, rule in segments.items():
        score = segment_score(rule, F.col("vibe_style"), F.col("_text"))
        entries.append(F.struct(F.lit(name).alias("segment"), score.alias("score"), tier_reward(rule, score).alias("reward")))
    kept = [c for c in items.columns if c not in ("score", "reward", "segment")]
    return items.withColumn("_text", text).select(*kept, F.inline(F.array(*entries)))


def segment_coverage(rewards: DataFrame) -> DataFrame:
    """Share of items with a positive reward per segment."""
    return rewards.groupBy("segment").agg(
        F.count(F.lit(1)).alias("items"), F.avg(F.when(F.col("reward") > 0, 1.0).otherwise(0.0)).alias("positive_rate")
    )


def id_segment_score(topic: Column, vibe: Column, liked: Sequence[int], hated: Sequence[int], vibes: Sequence[int]) -> Column:
    """Segment given as id lists: 0.45 base, minus 0.55 for hated topics, plus 0.35 liked ones, plus 0.25 liked styles."""
    score = (
        F.lit(0.45)
        - F.when(topic.isin(list(hated)), 0.55).otherwise(0.0)
        + F.when(topic.isin(list(liked)), 0.35).otherwise(0.0)
        + F.when(vibe.isin(list(vibes)), 0.25).otherwise(0.0)
    )
    return N.clamp(score, 0.0, 1.0)


# --- model parameters -----------------------------------------------------------------------------------------------


def merge_parameters(params: DataFrame, weights: Mapping[int, float], anchor: int) -> DataFrame:
    """Weighted average of named tensors over checkpoints; a tensor that does not fit everywhere keeps the anchor's values.

    ``params`` is (checkpoint, param, shape, dtype, idx, value) in long form.
    """
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    share = F.lit(0.0)
    for name, weight in weights.items():
        share = F.when(F.col("checkpoint") == name, weight / total).otherwise(share)
    shapes = params.select("checkpoint", "param", "shape", "dtype").distinct()
    fit = shapes.groupBy("param").agg(
        F.countDistinct("checkpoint").alias("_have"),
        F.countDistinct("shape", "dtype").alias("_kinds"),
        F.min("dtype").alias("_dtype"),
        F.max((F.col("checkpoint") == anchor).cast("int")).alias("_anchored"),
    )
    same = (F.col("_have") == len(weights)) & (F.col("_kinds") == 1) & F.startswith("_dtype", F.lit("float"))
    judged = fit.where("_anchored = 1").select("param", same.alias("averaged"))
    joined = params.join(judged, "param")
    value = F.when(F.col("averaged"), F.col("value") * share).otherwise(
        F.when(F.col("checkpoint") == anchor, F.col("value"))
    )
    # Rows of other checkpoints beyond the anchor's shape carry null only and drop out.
    merged = joined.withColumn("_v", value).groupBy("param", "idx").agg(F.max("averaged").alias("averaged"), F.sum("_v").alias("value"))
    return merged.where("value is not null")


def merge_meta(meta: DataFrame) -> DataFrame:
    """Largest value per metadata key over checkpoints."""
    return meta.groupBy("key").agg(F.max("value").alias("value"))
