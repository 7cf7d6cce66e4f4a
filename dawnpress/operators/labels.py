"""Event labels: cache lookup, fuzzy merging, label-based clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dawnpress.functions import text as T
from dawnpress.operators.frames import first_per_key
from dawnpress.session import cut_lineage

TINY = 1e-9
#: Characters that two labels have in common up to which they meet as a whole, about so many in a part beyond, and the characters
#: that a part may lose.
WHOLE, PART, PART_EDITS = 10, 7, 4
#: Keys that are made at once.
KEY_ROWS = 1 << 20
STEP = 0x9E3779B97F4A7C15
#: Labels whose keys are made, and pairs whose ratio is taken, in one task: few bytes, but much work.
TASK_LABELS = 10_000


def item_key(link: Column, headline: Column) -> Column:
    return T.text_id(F.concat_ws("|", T.text_or_empty(link), T.text_or_empty(headline)))


def cached_labels(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with their normalised cached label, items that still need one); ``cache`` is (key, event)."""
    keyed = items.withColumn("key", item_key(F.col("link"), F.col("headline")))
    joined = keyed.join(cache.where("trim(event) <> ''"), "key", "left")
    known = joined.where("event is not null").withColumn("label", T.event_label(F.col("event")))
    return known.drop("event"), joined.where("event is null").drop("event")


@F.pandas_udf(DoubleType())
def _ratio(later: pd.Series, earlier: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(later, earlier)], dtype=float)


def _common(total: int, threshold: float) -> int:
    """Characters that two labels of ``total`` characters must have in common, in order."""
    return math.ceil(threshold / 2 * total - TINY)


@lru_cache(maxsize=256)
def _keys(n: int, threshold: float) -> list[tuple[int, int, np.ndarray]]:
    """(common, part, places) for a label of ``n`` characters: each row of ``places`` are the characters of one key."""
    most: dict[int, list[tuple[int, int]]] = {}  # characters in common: what the label loses inside a part, and both together, at most
    for other in range(1, int(n * (2 - threshold) / threshold) + 2):
        common = _common(n + other, threshold)
        if 0 < common <= min(n, other):
            most.setdefault(common, []).append((n - common, n + other - 2 * common))
    found = []
    for common, losses in most.items():
        edits = int(2 * common / threshold + TINY) - 2 * common
        parts = min(common, 1 if common <= WHOLE and edits <= PART_EDITS else max(-(-common // PART), -(-(edits + 1) // PART_EDITS)))
        lost = n - common
        for part in range(parts):
            first, size = common * part // parts, common * (part + 1) // parts - common * part // parts
            for cut in range(max(min(own, both // parts) for own, both in losses) + 1):
                if size == 1 and cut:
                    break
                inner = list(combinations(range(1, size + cut - 1), size - 2)) if size > 1 else [()]
                ends = [(0, *i, size + cut - 1) if size > 1 else (0,) for i in inner]
                shape = np.array(ends, np.int64) + first
                found.append((common, part, np.concatenate([shape + x for x in range(lost - cut + 1)])))
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _label_keys(threshold: float):
    step = np.uint64(STEP)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, rows in batch.groupby("n"):
                keys = _keys(int(n), threshold)
                width = sum(len(places) for *_, places in keys) or 1
                chunk = max(1, KEY_ROWS // width)
                for at in range(0, len(rows), chunk):
                    some = rows.iloc[at : at + chunk]
                    text = np.frombuffer("".join(some["low"]).encode("utf-32-le"), np.uint32).reshape(len(some), n)
                    chars = _mixed(text.astype(np.uint64) * step)
                    marks = np.bitwise_xor.reduce(np.uint64(1) << (chars & np.uint64(63)), axis=1).view(np.int64)
                    made = []
                    for common, part, places in keys:
                        factors = _mixed(np.arange(1, places.shape[1] + 1, dtype=np.uint64) * step) | np.uint64(1)
                        key = np.zeros((len(some), len(places)), np.uint64)
                        for j in range(places.shape[1]):
                            key += chars[:, places[:, j]] * factors[j]
                        key = _mixed(key + np.uint64(((common << 8 | part) * STEP) % (1 << 64)))
                        key.sort(axis=1)
                        fresh = np.ones(key.shape, bool)
                        fresh[:, 1:] = key[:, 1:] != key[:, :-1]
                        who = np.nonzero(fresh)[0]
                        made.append((key[fresh].view(np.int64), who, np.full(len(who), common, np.int32)))
                    if made:
                        key, who, common = (np.concatenate(column) for column in zip(*made, strict=True))
                        yield pd.DataFrame({"key": key, "id": some["id"].to_numpy()[who], "marks": marks[who], "n": np.int32(n), "common": common})

    return run


def similar_labels(labels: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Pairs (later, earlier, score) of distinct labels whose matching ratio reaches the threshold.

    The order is length descending, then text. Candidates come from a lossless index. A ratio of t between lengths m >= n
    matches at least c = t * (m + n) / 2 characters in order, so both labels hold one sequence of c characters and lose m - c and
    n - c others. A label sends as keys all it can leave of itself: the whole sequence if it is short, else its parts, of
    which one has lost no more than its share of the characters; a part may start as late as the label has characters to lose. Labels
    meet by the 64-bit hash of a key. In the join itself each pair must have lengths that ask for that c, and marks (one bit a character, flipped by each occurrence) that differ in no more bits than characters are lost; only
    what is left is shuffled. Strings meet again for these pairs only, where edit distance and ratio decide.
    """
    if threshold <= 0.5:
        raise ValueError("the candidate filter is lossless for thresholds above one half only")
    rows = labels.select("label").where("label not in ('', 'General')").distinct()
    rows = rows.select("label", F.lower("label").alias("low"), F.xxhash64("label").alias("id"))
    rows = cut_lineage(rows.withColumn("n", F.length("low")).where("n > 0"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_LABELS))
    index = rows.select("id", "low", "n").repartition(tasks, "id").mapInPandas(_label_keys(threshold), "key bigint, id bigint, marks bigint, n int, common int")
    side = lambda end: index.select("key", *[F.col(c).alias(f"{end}_{c}") for c in ("id", "marks", "n", "common")])
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    total = a("n") + b("n")
    lost = total - 2 * a("common")
    met = side("a").join(side("b"), "key").where(
        (a("id") < b("id"))
        & (a("common") == b("common"))
        & (F.ceil(F.lit(threshold / 2) * total - F.lit(TINY)) == a("common"))
        & (F.bit_count(a("marks").bitwiseXOR(b("marks"))) <= lost)
    )
    met = met.select("a_id", "b_id").distinct()
    named = lambda end: rows.select(*[F.col(c).alias(f"{end}_{c}") for c in ("id", "low", "n", "label")])
    both = met.join(named("a"), "a_id").join(named("b"), "b_id")
    whole = lambda end: F.struct(*[F.col(f"{end}_{c}").alias(c) for c in ("n", "label", "low")])
    first = F.when((F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_label") < F.col("b_label"))), 0).otherwise(1)
    near = both.where(F.levenshtein("a_low", "b_low") <= F.floor(F.lit(1 - threshold) * (F.col("a_n") + F.col("b_n")) + F.lit(TINY)))
    ordered = near.select(F.when(first == 0, whole("a")).otherwise(whole("b")).alias("e"), F.when(first == 0, whole("b")).otherwise(whole("a")).alias("l"))
    scored = ordered.repartition(tasks, "l.label", "e.label").select(F.col("l.label").alias("later"), F.col("e.label").alias("earlier"), _ratio("l.low", "e.low").alias("score"))
    return scored.where(F.col("score") >= threshold).select("later", "earlier", "score")


def merge_labels(labels: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(label, canonical): a label joins its most similar earlier canonical label, otherwise it is canonical itself.

    Labels are taken longest first. Being canonical depends on which earlier labels are, so labels are decided in rounds:
    one without an undecided or canonical earlier neighbour is canonical, one with a canonical neighbour is not.
    """
    names = labels.select("label").distinct()
    pairs = cut_lineage(similar_labels(names, threshold))
    state = cut_lineage(names.select("label", F.lit("open").alias("state")))
    while True:
        seen = pairs.join(state.select(F.col("label").alias("earlier"), F.col("state").alias("_s")), "earlier")
        facts = seen.groupBy(F.col("later").alias("label")).agg(
            F.max((F.col("_s") == "open").cast("int")).alias("_open"), F.max((F.col("_s") == "kept").cast("int")).alias("_kept")
        )
        judged = state.join(facts, "label", "left")
        verdict = (
            F.when(F.col("state") != "open", F.col("state"))
            .when(F.col("_kept") == 1, "dropped")
            .when(F.coalesce("_open", F.lit(0)) == 0, "kept")
            .otherwise("open")
        )
        state = cut_lineage(judged.select("label", verdict.alias("state")))
        if state.where("state = 'open'").isEmpty():
            break
    kept = state.where("state = 'kept'").select(F.col("label").alias("earlier"))
    options = pairs.join(kept, "earlier").join(state.where("state = 'dropped'").select(F.col("label").alias("later")), "later")
    best = first_per_key(options, ["later"], [F.desc("score"), F.desc(F.length("earlier")), F.asc("earlier")])
    moved = best.select(F.col("later").alias("label"), F.col("earlier").alias("canonical"))
    return names.join(moved, "label", "left").withColumn("canonical", F.coalesce("canonical", "label"))


def label_clusters(labelled: DataFrame, min_size: int = 3, drop_general: bool = True, threshold: float | None = 0.92) -> DataFrame:
    """Event clusters by (merged) label as (cluster_id, item_id, event_label, size)."""
    rows = labelled.withColumn("event_label", F.col("label"))
    if threshold is not None:
        merged = merge_labels(labelled, threshold)
        rows = labelled.join(merged, "label").withColumn("event_label", F.col("canonical")).drop("canonical")
    if drop_general:
        rows = rows.where("event_label <> 'General'")
    sizes = rows.groupBy("event_label").agg(F.count(F.lit(1)).alias("size"), F.min("item_id").alias("cluster_id"))
    return rows.join(sizes.where(F.col("size") >= min_size), "event_label").select("cluster_id", "item_id", "event_label", "size")
