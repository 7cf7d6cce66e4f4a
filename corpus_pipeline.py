"""A training corpus from raw documents: drop toxic texts and near copies, mask personal data, mix sources, pack sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each result as Parquet to the shared checkpoint folder and reads it back for the next stage.
The models of the toxicity and personal-data stages are fitted to the stage's own input.

Nulls and edges are those of the operators: rows with null text pass the first and third stage and pack as an end id; of
rows that repeat an id the second stage keeps one; rows without an id are never near copies; rows that the mix takes no time go,
rows that it takes twice are two rows; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dawnpress.llm import mixing, packing, pii, simhash, toxicity
from dawnpress.llm.common import documents, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a Jaccard similarity of at least 0.8 of 5-word shingles."""
    return simhash.keep_first(docs, similarity=simhash.SIMILARITY)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trees, fingerprints, belief propagation and tokens cannot be said in SQL; tests hold what the stages are made of against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
