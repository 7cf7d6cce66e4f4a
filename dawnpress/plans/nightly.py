"""The nightly batch: demand, crawl selection, feature table, daily pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnpress.functions import text as T
from dawnpress.operators import features, ingest
from dawnpress.session import cut_lineage


def article_features(
    entries: DataFrame,
    existing: DataFrame | None,
    now: Column,
    target: int | None = None,
    wrapper_cap: int | None = None,
    mix: bool = False,
    diversity: bool = False,
    strict_sources: bool = False,
    drop_wrappers: bool = False,
    text_limit: int | None = None,
    entity_rules=None,
    event_rules=None,
) -> DataFrame:
    """Feed entries (pos, headline, summary, link, published_utc) to the feature table.

    Emotion reads the whole text unless ``text_limit`` is set. ``existing`` is a reconciled inventory whose rows lose
    against new ones. By default nothing is left out; ``target`` and ``wrapper_cap`` limit the feed entries taken, and ``mix``
    then picks the newest of the merged rows under caps per source, whatever their number.
    """
    chosen = ingest.candidates(entries, target, wrapper_cap)
    text = F.concat_ws(" ", "headline", "summary")
    mood = T.emotion(F.substring(text, 1, text_limit) if text_limit else text)
    fresh = chosen.withColumn("emotion", mood)
    if "vibe_style" not in fresh.columns:
        fresh = fresh.withColumn("vibe_style", T.style_of_emotion(F.col("emotion")))
    columns = ["pos", "headline", "summary", "link", "published_utc", "emotion", "vibe_style"]
    old = fresh.where(F.lit(False)) if existing is None else existing
    merged = ingest.merge_new_first(fresh.select(columns), old.select(columns))
    unique = ingest.headline_dedupe(merged, per_topic=diversity)
    if strict_sources:
        unique = unique.where(T.allowed_source(T.extract_domain(F.col("link"))))
    if drop_wrappers:
        unique = ingest.without_wrappers(unique)
    # Everything below reads the selected rows several times: write them once.
    selected = cut_lineage(unique)
    if mix:
        if target is None:
            raise ValueError("a mix needs a target")
        mixed = ingest.domain_mix(selected, target, target if wrapper_cap is None else wrapper_cap, now)
        selected = mixed.withColumn("pos", F.col("mix_pos")).drop("mix_pos")
    numbered = features.row_ids(selected, "pos", "item_id").drop("pos").withColumn("pos", F.col("item_id"))
    return features.build_features(numbered, now, entity_rules, event_rules)
