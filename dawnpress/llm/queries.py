"""One query per operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnpress.llm import (
    block_search,
    compression_bands,
    language,
    mixing,
    packing,
    pii,
    projections,
    simhash,
    spelling,
    sql,
    suffix_dedup,
    token_attribution,
    toxicity,
    turns,
)
from dawnpress.llm.common import documents, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    if fn.__name__ in sql.ORACLES:
        ORACLES[fn.__name__] = sql.ORACLES[fn.__name__]
    return fn


@query
def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.count_tokens(documents(spark, sf_dir))


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query
def op3_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.nearest_to_every(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).score(docs, "doc_id")
    held_out = remainder(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.score(documents(spark, sf_dir))


@query
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find(docs, pii.train(docs), "doc_id")
    counts = [pii.count_kind("base", k).alias(f"n_{k}") for k in pii.KINDS]
    sha = F.sha2(pii.digest("base"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, sha, pii.digest("spans").alias("spans"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_languages(documents(spark, sf_dir).select("doc_id", "text", "lang"))


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))
