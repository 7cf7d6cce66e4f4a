"""Spherical k-means whose result does not depend on how the rows are partitioned.

One pass over the vectors per round: each task assigns its rows to the nearest centre, notes how many of them the round before had
assigned otherwise, and adds up vectors and counts of each cluster. Only these sums leave a task, and at most ``k`` of them meet.
Sums are of whole numbers (components times 2^32), so their order does not matter; nearness is compared after rounding to nine
digits, ties go to the smaller cluster. Rounds end when at most a hundredth of the items move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnpress.functions import vectors as V
from dawnpress.session import cut_lineage

#: Share of the items that may still move in the last round.
MOVED = 0.01
FIXED_POINT = float(1 << 32)
DIGITS = 9


def usable(vectors: DataFrame) -> DataFrame:
    """``item_id, vec``: unit vectors of the items whose vector is not zero."""
    return vectors.where(V.norm(F.col("vec")) > 0).select("item_id", V.normalize(F.col("vec").cast("array<double>")).alias("vec"))


def first_centres(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors that come first in the order of a hash of seed and id; at most ``k`` rows reach the driver."""
    drawn = rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("item_id").cast("string"))), "item_id").limit(k)
    return np.array([r["vec"] for r in drawn.select("vec").collect()], float)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.round(points @ centres.T, DIGITS).argmax(axis=1)


def one_round(rows: DataFrame, centres: np.ndarray, before: np.ndarray | None) -> tuple[int, np.ndarray]:
    """How many items move from ``before`` to ``centres``, and the next centres; a cluster without items keeps its centre."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts, moved = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            points = np.stack(batch["vec"].to_list())
            at = nearest(points, centres)
            np.add.at(sums, at, np.rint(points * FIXED_POINT).astype(np.int64))
            counts += np.bincount(at, minlength=len(centres))
            moved += np.bincount(at[nearest(points, before) != at] if before is not None else at, minlength=len(centres))
        some = np.flatnonzero(counts)
        if not len(some):
            return
        yield pd.DataFrame({"cluster": some, "sums": list(sums[some]), "moved": moved[some]})

    parts = rows.select("vec").mapInPandas(add_up, "cluster int, sums array<bigint>, moved bigint")
    spread = parts.select("cluster", "moved", F.posexplode("sums").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"), F.sum("moved").alias("moved"))
    packed = spread.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("sums"), F.first("moved").alias("moved")).collect()
    found = centres.copy()
    for row in packed:  # one row a cluster
        total = np.array([s["x"] for s in row["sums"]], float)
        length = np.linalg.norm(total)
        if length > 0:
            found[row["cluster"]] = total / length
    return sum(row["moved"] for row in packed), found


def fit(rows: DataFrame, k: int, iterations: int = 18, seed: int = 1337) -> tuple[np.ndarray, int]:
    """Centres that the final assignment of the unit vectors ``rows`` is made by, and the rounds taken."""
    n = rows.count()
    centres, before = first_centres(rows, k, seed), None
    for taken in range(1, iterations + 1):
        if not len(centres):
            return centres, 0
        moved, following = one_round(rows, centres, before)
        if moved <= max(1, int(MOVED * n)) or taken == iterations:
            break
        before, centres = centres, following
    return centres, taken


def assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``cluster_id, item_id`` of the unit vectors ``rows``: their nearest centres."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = nearest(np.stack(batch["vec"].to_list()), centres)
                yield pd.DataFrame({"cluster_id": at, "item_id": batch["item_id"]})

    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInPandas(place, f"cluster_id int, item_id {kind}")


def spherical_kmeans(vectors: DataFrame, k: int = 280, iterations: int = 18, seed: int = 1337) -> DataFrame:
    """Cosine k-means assignment (cluster_id, item_id) of (item_id, vec); items whose vector is zero have none."""
    rows = cut_lineage(usable(vectors))
    centres, _ = fit(rows, k, iterations, seed)
    return assign(rows, centres)
