"""Items that share terms: groups without pairs, and pairs by prefix filter.

Items that share ``k`` of their terms share one set of ``k`` terms. For groups (components of the graph of such items) it is
enough that every item emits its sets as keys and hangs on the smallest item of each key: rows grow with the items, however many
share a term.

Where the pairs themselves are asked for, each item's terms are ordered by rarity and only the first ``n - k + 1`` of its ``n`` terms
propose partners: two items that share ``k`` terms share one of these. The most frequent terms, whose buckets are largest, thus
propose nothing. Items travel to the buckets with their terms, so a pair is judged where it meets, in the bucket of its rarest common
term only: pairs are neither shuffled nor made distinct, and a task holds one tile of them (``judged_in_tiles``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnpress.session import cut_lineage

#: Items of a bucket that are dealt to one block; two blocks meet in one group.
BLOCK_ROWS = 4096
#: Items of either side of a tile.
TILE_ROWS = 1024
#: Rows and pairs of a partition that is judged in one task; more of them make more partitions.
TASK_ROWS, TASK_PAIRS = 100_000, 100_000_000
#: Items of more terms send them to no bucket; their pairs are proposed first and verified by a join.
LONG_TERMS = 128


def term_sets(rows: DataFrame, k: int, term: str = "term") -> DataFrame:
    """``item_id, key`` for every set of ``k`` different terms of (item_id, term) rows; a key is an ordered array of terms."""
    if k < 1:
        raise ValueError("a set holds at least one term")
    sets = rows.groupBy("item_id").agg(F.array_sort(F.collect_set(term)).alias("_terms")).where(F.size("_terms") >= k)
    grown = sets.select("item_id", "_terms", F.array().cast("array<string>").alias("key"), F.lit(0).alias("_next"))
    for left in range(k - 1, -1, -1):  # a next term leaves enough terms for the others
        places = F.sequence(F.col("_next"), F.size("_terms") - 1 - left)
        picked = grown.select("item_id", "_terms", "key", F.explode(places).alias("_at"))
        key = F.concat("key", F.array(F.get("_terms", F.col("_at")).cast("string")))
        grown = picked.select("item_id", "_terms", key.alias("key"), (F.col("_at") + 1).alias("_next"))
        if left:
            grown = grown.where(F.col("_next") + left <= F.size("_terms"))
    return grown.select("item_id", "key")


def stars(keyed: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Distinct ``src, dst``: every item of a key with the smallest item of that key. Keys of one item give nothing."""
    ends = keyed.groupBy(*keys).agg(F.min("item_id").alias("dst"), F.max("item_id").alias("_last")).where("dst < _last").drop("_last")
    return keyed.join(ends, list(keys)).where("item_id > dst").select(F.col("item_id").alias("src"), "dst").distinct()


def linked_by_terms(rows: DataFrame, k: int, term: str = "term") -> DataFrame:
    """Stars whose components are those of all pairs of items that share at least ``k`` terms."""
    return stars(term_sets(rows, k, term))


def ordered_terms(rows: DataFrame, k: int, group: Sequence[str] = (), term: str = "term") -> DataFrame:
    """``*group, item_id, terms``: of items that have at least ``k``, those terms that another item of the group has, the rarest first.

    A term of a group is given by a number of its own.
    """
    once = cut_lineage(rows.select(*group, "item_id", term).distinct())
    counted = once.groupBy(*group, term).agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    counted = cut_lineage(counted.withColumn("_id", F.monotonically_increasing_id()))
    held = once.join(counted, [*group, term]).select(*group, "item_id", F.struct("_df", "_id").alias("_place"))
    packed = held.groupBy(*group, "item_id").agg(F.array_sort(F.collect_list("_place")).alias("_places"))
    return packed.where(F.size("_places") >= k).select(*group, "item_id", F.transform("_places", lambda p: p["_id"]).alias("terms"))


def in_blocks(rows: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Rows of (``_term``, item_id, ...) dealt to the pairs of blocks of their bucket, every group ``_term, _low, _high`` in one piece of a partition.

    A bucket of more than ``block`` rows is dealt to blocks and every two blocks meet in a group of their own, so no bucket is too
    large for a task and none is left out. Buckets of one row are dropped. The number of partitions follows the rows and pairs.
    """
    sizes = rows.groupBy("_term").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    blocks = sizes.withColumn("_blocks", F.ceil(F.col("_rows") / block).cast("int"))
    spark = rows.sparkSession
    work = blocks.agg(F.sum(F.col("_rows") * F.col("_blocks")), F.sum(F.col("_rows").cast("double") * F.col("_rows") / 2)).first()
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism,
        int((work[0] or 0) / TASK_ROWS) + 1, int((work[1] or 0) / TASK_PAIRS) + 1,
    )
    own = F.pmod(F.xxhash64("item_id"), F.col("_blocks")).cast("int")
    dealt = rows.join(blocks.drop("_rows"), "_term").withColumn("_own", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = dealt.withColumn("_low", F.least("_own", "_other")).withColumn("_high", F.greatest("_own", "_other")).drop("_blocks", "_other")
    keys = ["_term", "_low", "_high"]
    return placed.repartition(tasks, *keys).sortWithinPartitions(*keys, "_own", "item_id")


class Lists:
    """A list column as one array of values and the bounds of every row."""

    def __init__(self, column: pa.ChunkedArray, dtype: type = np.int64):
        lists = column.combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        self.sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.values = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)

    def entries(self, side: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of some rows, the row of each (from 0) and its place in the row's list."""
        bounds, sizes = self.bounds[side.start : side.stop + 1], self.sizes[side]
        rows = np.repeat(np.arange(len(sizes)), sizes)
        return self.values[bounds[0] : bounds[-1]], rows, np.arange(bounds[0], bounds[-1]) - bounds[:-1][rows]


def met_in(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """How many values every row of one side shares with every row of the other; a side is (values, rows)."""
    values, rows = left
    order = np.argsort(right[0], kind="stable")
    others, at = right[0][order], right[1][order]
    low = np.searchsorted(others, values)
    n = np.searchsorted(others, values, "right") - low
    values, rows, low, n = values[n > 0], rows[n > 0], low[n > 0], n[n > 0]
    shared = np.zeros(shape, np.int32)
    if n.sum() > 3000 * len(values):  # long runs of holders: one block of the tile per value
        order = np.argsort(values, kind="stable")
        for first, stop in group_bounds({"value": values[order]}, ["value"]):
            one = order[first:stop]
            shared[rows[one][:, None], at[low[one[0]] : low[one[0]] + n[one[0]]]] += 1
        return shared
    ends = np.cumsum(n)
    for cut in np.split(np.arange(len(n)), np.searchsorted(ends, np.arange(1_000_000, ends[-1] if len(n) else 0, 1_000_000))):
        many = n[cut]
        if len(many):
            places = np.repeat(low[cut] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            shared += np.bincount(np.repeat(rows[cut], many) * shape[1] + at[places], minlength=shape[0] * shape[1]).reshape(shape).astype(np.int32)
    return shared


def shared_in(lists: Lists, left: slice, right: slice) -> np.ndarray:
    """How many values every row of ``left`` shares with every row of ``right``."""
    return met_in(lists.entries(left)[:2], lists.entries(right)[:2], (left.stop - left.start, right.stop - right.start))


def spanning(linked: np.ndarray) -> np.ndarray:
    """Of the links between the rows and columns of a matrix, so many that the same groups hang together (at most one per row and column)."""
    kept = np.zeros_like(linked)
    row_left, column_left = linked.any(1), linked.any(0)
    while row_left.any():
        rows = np.flatnonzero(row_left)[:1]
        row_left[rows] = False
        while len(rows):
            columns = np.flatnonzero(column_left)
            reached = linked[np.ix_(rows, columns)]
            new = reached.any(0)
            kept[rows[reached.argmax(0)[new]], columns[new]] = True
            columns = columns[new]
            column_left[columns] = False
            rest = np.flatnonzero(row_left)
            if not len(columns) or not len(rest):
                break
            reached = linked[np.ix_(rest, columns)]
            new = reached.any(1)
            kept[rest[new], columns[reached.argmax(1)[new]]] = True
            rows = rest[new]
            row_left[rows] = False
    return kept


class Tile:
    """Two runs of rows of one group, of which every pair of different items (``fresh``) meets for the first time.

    ``shared`` counts the terms that a fresh pair shares, the bucket's included.
    """

    def __init__(self, item: np.ndarray, at: np.ndarray, terms: Lists, left: slice, right: slice, ordered: bool):
        self.left, self.right, self.item = left, right, item
        self.fresh = np.ones((left.stop - left.start, right.stop - right.start), bool)
        if ordered:
            self.fresh &= item[left][:, None] < item[right]
        sides = [(*terms.entries(side), at[side]) for side in (left, right)]
        early = [(values[place < own[rows]], rows[place < own[rows]]) for values, rows, place, own in sides]
        if len(early[0][0]) and len(early[1][0]):  # they have met in the bucket of a rarer term
            self.fresh &= met_in(*early, self.fresh.shape) == 0
        late = [(values[place > own[rows]], rows[place > own[rows]]) for values, rows, place, own in sides]
        self.shared = met_in(*late, self.fresh.shape) + 1

    def pairs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Smaller and larger item of the chosen pairs, and their places in the tile."""
        i, j = np.nonzero(chosen)
        a, b = self.item[self.left][i], self.item[self.right][j]
        return np.minimum(a, b), np.maximum(a, b), (i, j)


def judged_in_tiles(
    sets: DataFrame, k: int, prepare: Callable[[pa.Table], Callable[[Tile], Sequence[np.ndarray] | None]], schema: str, block: int = BLOCK_ROWS
) -> DataFrame:
    """What ``prepare(rows)(tile)`` finds among the pairs of items that share one of their first terms, as columns of ``schema``.

    ``sets`` is (item_id, terms, ...) as of ``ordered_terms``; items may have several rows. Every pair of rows of two items that
    share ``k`` terms is fresh in exactly one tile.
    """
    known = sets.where("item_id IS NOT NULL")
    first = F.slice("terms", 1, F.size("terms") - (k - 1))
    rows = in_blocks(known.select("*", F.posexplode(first).alias("_at", "_term")), block)
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting = [], 0
        for table in whole_groups(batches, ["_term", "_low", "_high"]):
            item, at, own = (table[name].to_numpy() for name in ("item_id", "_at", "_own"))
            judge, terms = prepare(table), Lists(table["terms"])
            for start, stop in group_bounds(table, ["_term", "_low", "_high"]):
                middle = start + int(np.searchsorted(own[start:stop], own[stop - 1]))
                for left, right, ordered in tiles_of(start, middle, stop, table["_low"][start].as_py() == table["_high"][start].as_py()):
                    columns = judge(Tile(item, at, terms, left, right, ordered))
                    if columns is not None and len(columns[0]):
                        found.append(columns)
                        waiting += len(columns[0])
                    if waiting >= 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)
                        found, waiting = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def tiles_of(start: int, middle: int, stop: int, one_block: bool) -> Iterator[tuple[slice, slice, bool]]:
    """Runs of rows that meet: those of one block in order of their items, or those of the lower block with those of the higher."""
    cut = lambda low, high: [slice(at, min(at + TILE_ROWS, high)) for at in range(low, high, TILE_ROWS)]
    if one_block:
        runs = cut(start, stop)
        for n, left in enumerate(runs):
            for right in runs[n:]:
                yield left, right, True
    elif start < middle:
        for left in cut(start, middle):
            for right in cut(middle, stop):
                yield left, right, False


def group_bounds(table: pa.Table | dict[str, np.ndarray], keys: Sequence[str]) -> list[tuple[int, int]]:
    """First and last row (exclusive) of every run of equal keys."""
    columns = [np.asarray(table[key]) for key in keys]
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for column in columns:
        new |= np.diff(column) != 0
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
    return list(zip(edges[:-1], edges[1:], strict=True))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Sorted rows as tables that cut no group; a table holds a batch and at most one group more."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = group_bounds(pa.Table.from_batches([batch]), keys)
        if kept and any(kept[-1][key][-1].as_py() != batch[key][0].as_py() for key in keys):
            yield pa.Table.from_batches(kept).combine_chunks()
            kept = []
        if len(ends) > 1:
            yield pa.Table.from_batches([*kept, batch.slice(0, ends[-1][0])]).combine_chunks()
            kept, batch = [], batch.slice(ends[-1][0])
        kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def sharing_pairs(rows: DataFrame, k: int, group: Sequence[str] = (), term: str = "term", block: int = BLOCK_ROWS) -> DataFrame:
    """``a, b, shared`` for all items ``a < b`` of one group that share ``shared >= k`` terms of (*group, item_id, term) rows.

    An item may be in one group only. Pairs of items with at most ``LONG_TERMS`` terms are judged in tiles.
    """
    sets = cut_lineage(ordered_terms(rows, k, group, term))
    kind = sets.schema["item_id"].dataType.simpleString()

    def prepare(_: pa.Table) -> Callable[[Tile], Sequence[np.ndarray]]:
        def judge(tile: Tile) -> Sequence[np.ndarray]:
            a, b, places = tile.pairs(tile.fresh & (tile.shared >= k))
            return a, b, tile.shared[places].astype(np.int64)

        return judge

    short = sets.where(F.size("terms") <= LONG_TERMS).select("item_id", "terms")
    found = judged_in_tiles(short, k, prepare, f"a {kind}, b {kind}, shared bigint", block)
    long = sets.where(F.size("terms") > LONG_TERMS)
    return found if long.isEmpty() else found.unionByName(_with_long(sets, k))


def _with_long(sets: DataFrame, k: int) -> DataFrame:
    """The pairs of ``sharing_pairs`` of which an item has more than ``LONG_TERMS`` terms: proposed by first terms, verified by a join."""
    first = F.slice("terms", 1, F.size("terms") - (k - 1))
    proposing = sets.select("item_id", (F.size("terms") > LONG_TERMS).alias("_long"), F.explode(first).alias("_term"))
    long = proposing.where("_long").select(F.col("item_id").alias("_x"), "_term")
    other = proposing.select(F.col("item_id").alias("_y"), "_long", "_term")
    met = long.join(other, "_term").where("_x < _y OR (_x > _y AND NOT _long)")
    pairs = met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()
    side = lambda end: sets.select(F.col("item_id").alias(end), F.col("terms").alias(f"_{end}"))
    shared = F.size(F.array_intersect("_a", "_b")).cast("bigint")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", shared.alias("shared")).where(F.col("shared") >= k)
