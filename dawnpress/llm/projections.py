"""Near-duplicate vectors of one label by sorted projection passes.

In every pass the vectors of a label are ordered by 64 concatenated signs of random projections, drawn anew, and each is compared in
double precision with the ``WINDOW`` before it in that order. Blocks of the order are groups of bounded size that also get
the window before their first row. Pairs of the cosine are contracted to stars inside their block, so a pass sends at most one link a
vector however dense a group is, and links of all passes are united to components.

The windows of a group with more members than a window do not show all its links. So those are counted afterwards:
the vectors of a component meet in tiles of bounded size, which count links and send no pairs. Every link of a vector is inside its
component, so counts are whole if the passes have connected what is near; a pair of cosine 0.98 keeps all of the first ``b`` signs of
a pass with probability 0.936 to the ``b``, where ``b`` is the logarithm of the label's vectors over the window.

Equal vectors of a label are one class with a count and never meet as pairs.

Nulls and edges: rows whose label is null or whose vector is null, empty, zero or holds null or non-finite components link with
nothing and are kept; vectors of different lengths do not link; rows that repeat a ``vec_id`` are separate vectors; a
null ``vec_id`` links like any other, but names no component, and is kept only if no id is linked with it; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnpress.llm.common import as_batch, map_batches, stored, to_arrow
from dawnpress.operators.graph import connected_components

COSINE = 0.98
#: Orders, vectors before one that it is compared with, and vectors of a block of the order.
PASSES, WINDOW, BLOCK = 6, 512, 4096
BITS = 64
SEED = 42
#: Vectors of a component in one block of a tile, and rows of small components in one group.
TILE, BIN = 2048, 8192
#: Rows of a tile that are multiplied at once.
STRIP = 512


def matrix(column) -> np.ndarray:
    """Rows of equal length as doubles."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors over their norms; the largest component is divided out first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def labelled(vectors: DataFrame, id_name: str = "vec_id", name: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, size, vector, digest`` of every row; label and digest are null where the row takes no part."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_name).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(name).alias("vector"))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("sound", sound)
    kind = marked.schema["vector"].dataType.simpleString()
    taken = marked.select("vec_id", F.when(F.col("sound"), F.col("label")).alias("label"), F.when(F.col("sound"), F.col("vector")).alias("vector"))

    def run(batch):
        values = batch.column(2)
        flat, ends = values.flatten().to_numpy(zero_copy_only=False) + 0.0, np.cumsum([0 if n is None else n for n in pa.compute.list_value_length(values).to_pylist()])
        parts = np.split(flat, ends[:-1]) if len(ends) else []
        digests = [hashlib.blake2b(p.tobytes(), digest_size=16).digest() if len(p) else None for p in parts]
        return {"vec_id": batch.column(0), "label": batch.column(1), "size": [len(p) for p in parts], "vector": values, "digest": digests}

    return map_batches(taken, run, f"vec_id long, label string, size int, vector {kind}, digest binary")


def classes_of(rows: DataFrame) -> DataFrame:
    """``node, label, size, digest, first_id, n, vector``: the distinct vectors of each label."""
    keys = ["label", "size", "digest"]
    grouped = rows.where("digest IS NOT NULL").groupBy(*keys).agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    return grouped.withColumn("node", F.monotonically_increasing_id())


def planes(size: int, passes: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, passes * BITS))


def signatures(classes: DataFrame, passes: int) -> DataFrame:
    """``node, label, size, signs``: for each pass the concatenated signs of a vector, as a number."""

    def run(batch):
        sizes = batch.column(2).to_numpy()
        signs = np.zeros((batch.num_rows, passes), np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            projected = units(matrix(batch.column(3).take(pa.array(at)))) @ planes(int(size), passes)
            signs[at] = np.packbits(projected > 0, axis=1).view(">i8")
        return {"node": batch.column(0), "label": batch.column(1), "size": batch.column(2), "signs": list(signs)}

    return map_batches(classes.select("node", "label", "size", "vector"), run, "node long, label string, size int, signs array<long>", rows=4096)


def placed(signed: DataFrame, window: int, block: int) -> DataFrame:
    """``node, pass, block, place``: blocks of the order of every pass that a vector belongs to or lies before."""
    keys = signed.select("node", "label", "size", F.posexplode("signs").alias("pass", "sign"))
    # after a sort these ids grow with the order: the task's number, then the row's in its task
    ordered = stored(keys.sort("pass", "size", "label", "sign", "node").select("node", "pass", F.monotonically_increasing_id().alias("id")))
    ordered = ordered.select("node", "pass", F.shiftright("id", 33).alias("task"), F.col("id").bitwiseAND((1 << 33) - 1).alias("row"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("task").agg(F.count(F.lit(1)).alias("rows"))
    offsets = counts.select("task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    at = ordered.join(offsets, "task").select("node", "pass", (F.col("row") + F.col("offset")).alias("place"))
    home = F.floor(F.col("place") / block)
    both = F.when(F.col("place") % block >= block - window, F.array(home, home + 1)).otherwise(F.array(home))
    return at.select("node", "pass", "place", F.explode(both).alias("block"))


def window_links(vectors: np.ndarray, labels: np.ndarray, cosine: float, window: int) -> np.ndarray:
    """For vectors in order: the first of those that links inside windows connect with each, itself if none."""
    pairs = []
    for a in range(0, len(vectors), STRIP):
        low = max(0, a - window)
        near = vectors[a : a + STRIP] @ vectors[low : a + STRIP].T >= cosine
        row, column = np.nonzero(near)
        row, column = row + a, column + low
        met = (column < row) & (row - column <= window) & (labels[row] == labels[column])
        pairs.append((row[met], column[met]))
    row, column = (np.concatenate(x) for x in zip(*pairs, strict=True))
    root = np.arange(len(vectors))
    while len(row):
        least = root.copy()
        np.minimum.at(least, root[row], root[column])
        np.minimum.at(least, root[column], root[row])
        while (least[least] != least).any():
            least = least[least]
        if (least == root).all():
            break
        root = least[root]
    return root


def links(classes: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Distinct ``src, dst``: stars that connect the nodes linked inside the windows of all passes."""
    window = min(window, block)
    at = placed(signatures(classes, passes), window, block)
    dealt = at.join(classes.select("node", "label", "size", "vector"), "node")
    kinds = to_arrow("src long, dst long")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        node = table["node"].to_numpy()
        _, labels = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)
        root = window_links(units(matrix(table["vector"])), labels, cosine, window)
        far = root != np.arange(len(root))
        return pa.Table.from_batches([as_batch({"src": node[far], "dst": node[root[far]]}, kinds)])

    found = dealt.groupBy("pass", "size", "block").applyInArrow(run, "src long, dst long")
    return found.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def count_links(members: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """``node, linked`` of ``members`` (``node, component, size, n, vector``): how many vectors of other nodes of the component are linked."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"))
    bins = max(1, -(-members.count() // BIN))
    cut = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = spread.select(
        "node", "component", "own", "n", "vector",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("bin"),
        (F.col("blocks") == 1).alias("small"), "size",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
    )
    kinds = to_arrow("node long, linked long")

    def run(table: pa.Table) -> pa.Table:
        node, component, own, n = (table[c].to_numpy() for c in ("node", "component", "own", "n"))
        vectors, i, j = units(matrix(table["vector"])), table["i"][0].as_py(), table["j"][0].as_py()
        order = np.lexsort((node, component))
        ends = np.flatnonzero(np.diff(component[order])) + 1
        linked = np.zeros(len(node), np.int64)
        for at in np.split(order, ends):
            left, right = (at, at) if i == j else (at[own[at] == i], at[own[at] == j])
            for a in range(0, len(left), STRIP):
                some = left[a : a + STRIP]
                near = (vectors[some] @ vectors[right].T >= cosine) & (node[some][:, None] != node[right])
                linked[some] += near @ n[right]
                if i != j:
                    linked[right] += n[some] @ near
        return pa.Table.from_batches([as_batch({"node": node, "linked": linked}, kinds)])

    found = dealt.groupBy("bin", "small", "size", "i", "j").applyInArrow(run, "node long, linked long")
    return found.groupBy("node").agg(F.sum("linked").alias("linked"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    rows = stored(labelled(vectors))
    classes = stored(classes_of(rows))
    met = stored(links(classes, cosine, passes, window, block))
    ends = met.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    roots = stored(connected_components(met, ends, "node", "component"))
    members = stored(classes.join(roots, "node").select("node", "component", "size", "first_id", "n", "vector"))
    first = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = members.join(first, "component").join(count_links(members, cosine, tile), "node").select("node", "linked", "component_id")
    named = classes.join(linked, "node", "left").select(
        "label",
        "size",
        "digest",
        (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.when(F.col("linked").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    alone = F.col("n_links").isNull()
    found = rows.drop("vector").join(stored(named), ["label", "size", "digest"], "left")
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
