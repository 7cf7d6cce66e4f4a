"""Story clustering end to end: portion, vectors, k-means, refine, prune, merge, cores, selection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnpress.functions import numeric as N
from dawnpress.functions import text as T
from dawnpress.functions import wordlists as W
from dawnpress.operators import clustering as C
from dawnpress.operators import ingest
from dawnpress.operators.spherical import spherical_kmeans
from dawnpress.session import cut_lineage


def story_features(items: DataFrame, ngram_idf: float = 5.2, categories=None) -> DataFrame:
    """(item_id, category, entities, ngrams) of cleaned items; n-grams below ``ngram_idf`` are too common to link."""
    slug = T.entity_slug(F.col("entity_key"))
    named = F.concat(T.entities_strict(F.col("raw_headline")), F.when(slug.isNotNull(), F.array(slug)).otherwise(F.array()))
    base = cut_lineage(items.select(
        "item_id",
        T.category(F.concat_ws(" ", "headline", "summary"), categories).alias("category"),
        F.array_distinct(named).alias("entities"),
        T.headline_ngrams(T.long_tokens(F.col("headline"))).alias("grams"),
    ))
    grams = base.select("item_id", F.explode("grams").alias("token"))
    total = items.agg(F.count(F.lit(1))).scalar()
    rare = C.document_frequency(grams).where(N.inverse_frequency(total, F.col("df")) >= ngram_idf)
    kept = grams.join(rare.select("token"), "token", "left_semi").groupBy("item_id").agg(F.collect_set("token").alias("ngrams"))
    return base.drop("grams").join(kept, "item_id", "left").withColumn(
        "ngrams", F.coalesce("ngrams", F.array().cast("array<string>"))
    )


def story_clusters(
    articles: DataFrame,
    now: Column,
    target: int | None = None,
    overfetch: int | None = None,
    k: int = 280,
    dim: int = 256,
    min_size: int = 3,
    min_cohesion: float = 0.60,
    min_title: float = 0.10,
    merge_sim: float = 0.85,
    one_per_event: bool = False,
    quotas: Mapping[str, int] = W.STORY_QUOTAS,
    categories=None,
) -> tuple[DataFrame, DataFrame]:
    """(all cores, selected cores) of every article.

    ``target`` (after title deduplication) and ``overfetch`` (before it) are an explicit request for the newest articles only.
    """
    items = ingest.clean_items(articles)
    if overfetch is not None:
        items = ingest.recent_portion(items, overfetch)
    items = ingest.title_dedupe(cut_lineage(items), one_per_event=one_per_event)
    if target is not None:
        items = ingest.recent_portion(items, target)
    items = cut_lineage(items)
    count = items.count()
    vectors = cut_lineage(C.random_index_vectors(C.embedding_terms(items), count, dim))
    assigned = cut_lineage(spherical_kmeans(vectors, max(2, min(k, count))))
    features = cut_lineage(story_features(items, categories=categories))
    entities = features.select("item_id", F.explode("entities").alias("entity"))
    frequency = C.document_frequency(entities, "entity")

    sized = C.clusters_of_size(assigned, min_size).select(F.col("cluster_id").cast("bigint").alias("cluster_id"), "item_id")
    quality = cut_lineage(C.cohesion(sized, vectors))
    tight = sized.join(quality.where(F.col("cohesion") >= min_cohesion).select("cluster_id"), "cluster_id", "left_semi")
    loose = sized.join(quality.where(F.col("cohesion") < min_cohesion).select("cluster_id"), "cluster_id", "left_semi")
    pairs = C.gated_pairs(loose, features.join(vectors, "item_id"), frequency, links_only=True)
    split = C.split_clusters(loose, pairs, min_size)
    # Split clusters are named after an item: keep them apart from the k-means numbers.
    refined = cut_lineage(tight.unionByName(split.select((F.col("cluster_id") + k).alias("cluster_id"), "item_id")))

    titles = C.unit_weights(C.term_weights(items.select("item_id", F.explode(T.tokenize(F.col("headline"))).alias("token")), count))
    pruned = cut_lineage(C.prune_by_titles(refined, cut_lineage(titles), min_title, min_size))
    merged = cut_lineage(C.merge_clusters(pruned, vectors, entities, merge_sim))
    described = items.join(features.select("item_id", "category"), "item_id")
    cores = cut_lineage(C.with_bucket_and_score(C.cluster_cores(merged, described, vectors, now, min_size, min_cohesion)))
    return cores, C.select_by_quota(cores, quotas)
