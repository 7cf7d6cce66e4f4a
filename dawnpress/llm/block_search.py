"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt to blocks of bounded size and every pair of blocks is one task. There both sides are rounded
to int8 with a scale per vector and multiplied as a tile. The product is exact for the rounded vectors, and the
norms of what rounding lost bound its distance from the true inner product (Cauchy-Schwarz). A candidate whose upper bound
is below the query's k-th best lower bound cannot be among the nearest of the tile; the other pairs are computed again
in double precision, so the result is exact. Each tile sends at most k pairs of a query; these are merged by k-heaps: Spark
cuts every task's pairs to the best k of a query before the shuffle.

Equal vectors are a hot group: only the k + 1 smallest ids of each distinct vector are searched, as no others can be
in a result that gives ties to the smaller id.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id;
of several vectors with one id the smallest counts; vectors of different lengths do not meet; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnpress.llm.common import as_batch, stored, to_arrow

K = 20
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Queries multiplied at once in a tile, for bounded memory.
STRIP = 128
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_name: str = "vec_id", name: str = "embedding") -> DataFrame:
    """``vec_id, vector`` (double) of the rows that take part."""
    vector = F.transform(F.col(name), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_name).cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = rows.where(~bad & F.exists("vector", lambda x: x != 0))
    return sound.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy().reshape(len(values), -1)


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scale, and the norms of the rounded vectors and of what rounding lost."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(vectors - near, axis=1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


def tile(ids: np.ndarray, queries: np.ndarray, others: np.ndarray, candidates: np.ndarray, k: int):
    """Per query the ``k`` best candidates of the tile: query and candidate positions and exact products."""
    q, q_scale, q_norm, q_lost = rounded(queries)
    c, c_scale, c_norm, c_lost = rounded(candidates)
    exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of products stay whole numbers
    c = c.astype(exact).T
    out = []
    for a in range(0, len(ids), STRIP):
        some = slice(a, a + STRIP)
        product = (q[some].astype(exact) @ c) * (q_scale[some, None] * c_scale)
        slack = q_norm[some, None] * c_lost + q_lost[some, None] * (c_norm + c_lost)
        slack += 1e-9 * (np.abs(product) + slack) + 1e-300
        product[ids[some, None] == others] = -np.inf
        lower = product - slack
        best = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(lower), -np.inf)
        row, column = np.nonzero((product + slack >= best[:, None]) & np.isfinite(product))
        for p in range(0, len(row), 1 << 16):  # computed again in double precision
            r, j = row[p : p + (1 << 16)], column[p : p + (1 << 16)]
            out.append((a + r, j, products(queries[a + r], candidates[j])))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    row, column, score = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((others[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], column[keep], score[keep]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates of largest inner product for every query, itself not counted.

    Both sides are ``vec_id, vector`` as ``usable`` gives them.
    """
    same = Window.partitionBy("vector").orderBy("vec_id")
    searched = stored(candidates.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth"))
    queries = stored(queries)
    n_queries, n_candidates = queries.count(), searched.count()
    q_blocks, c_blocks = -(-n_queries // query_block) or 1, -(-n_candidates // candidate_block) or 1
    kinds, block = to_arrow(FOUND), lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        ids, others = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        row, column, score = tile(ids, _matrix(left["vector"]), others, _matrix(right["vector"]), k)
        return pa.Table.from_batches([as_batch({"query_id": ids[row], "vec_id": others[column], "score": score}, kinds)])

    size = F.size("vector").alias("size")
    left = queries.select("vec_id", "vector", size, block(q_blocks).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c"))
    right = searched.select("vec_id", "vector", size, block(c_blocks).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"))
    keys = ["size", "q", "c"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(join, FOUND)
    heap = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(heap)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_to_every(vectors: DataFrame, divisor: int = 20, k: int = K) -> DataFrame:
    """Queries are the rows whose id is divisible by ``divisor``, candidates all rows."""
    rows = stored(usable(vectors))
    return nearest(rows.where(F.col("vec_id") % divisor == 0), rows, k)
