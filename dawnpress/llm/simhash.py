"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most ``2 h`` bits have a common variant within ``h`` bits of both. Every distinct
fingerprint emits all its variants of at most ``h`` changed bits, the variants are shuffled, and fingerprints that meet at a
variant are linked. All fingerprints at one variant are within ``2 h`` bits of each other, so linking each to its
neighbour in sorted order gives the same components as all pairs would, with no pair expansion; a variant is reached by
at most 65 distinct fingerprints (``h`` = 1), so no key is hot. Equal documents share one fingerprint and never travel
as pairs.

Nulls and edges: null and empty texts have fingerprint zero and are linked like any other; a text of one or two words is
one shingle; rows that repeat a ``doc_id`` are separate members; rows with a null ``doc_id`` get a fingerprint and the
smallest non-null id of their component (null if it has none); other columns are ignored; an empty table gives no rows.

``near_copies`` is the setting for a stage that drops near copies: documents are linked if the Jaccard similarity of their sets of
5-word shingles is at least 0.8, which lies far outside a ball of two bits. Each text gets eight short fingerprints of 32 bits,
a bit being one bit of the least hash of its shingles under one of 256 hash functions, so that it differs with probability
(1 - similarity) / 2. Each short fingerprint is ball-hashed as above (33 variants, 264 a text). Those that meet are compared by all 256
bits and, if these agree well enough, by their exact similarity. A pair of similarity 0.8 meets with probability 0.974, of
0.9 with 0.9999. Texts are not paired: each is verified against one other first, and texts so linked are one component. Of every
component that a variant holds its first member there is the leader. While a variant holds several components, their leaders are
verified against the first of them, then the first eight, and so on, until all leaders that meet have been compared. So in groups
of copies pairs grow with the number of texts and rounds with its logarithm, whatever the size of a group. A text stays apart
only if it is similar to no leader in any of its 264 variants.
Here rows without an id take no part, and rows of one id are one document with several texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnpress.llm.common import map_batches, stored
from dawnpress.operators.graph import connected_components

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once, so that memory does not follow the length of a text.
CHUNK = 1 << 15
#: Setting of ``near_copies``: words of a shingle, least Jaccard similarity, short fingerprints of a text and their bits.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
SHORT, SHORT_BITS = 8, 32
#: Most of the 256 bits that may differ: at similarity 0.8 25.6 do on average with a deviation of 4.8, of unrelated texts 128.
MOST_BITS = 56
#: Shingles that are hashed by all functions at once.
HASHED = 1 << 11
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, (SHORT * SHORT_BITS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(words: list[bytes], shingle: int) -> tuple[Iterator[bytes], int]:
    """All shingles of at least one word and their number."""
    n = len(words)
    joined = b" ".join(words)
    if n <= shingle:
        return iter([joined]), 1
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - shingle]]
    return (joined[a : b - 1] for a, b in zip(starts, ends[shingle - 1 :], strict=True)), n - shingle + 1


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of UTF-8 bytes: a bit is set if it is set in over half of the shingles' XXH64."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    grams, total = shingles(words, shingle)
    counts = np.zeros(BITS, np.int64)
    for _ in range(0, total, CHUNK):
        some = b"".join([digest(g, SEED) for g in islice(grams, CHUNK)])
        counts += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > total).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row of ``docs``."""

    def run(batch):
        return {"doc_id": batch.column(0), "fp": [simhash(t, shingle) for t in batch.column(1).to_pylist()]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, fp long")


def masks(radius: int, bits: int = BITS) -> list[int]:
    """Changes of at most ``radius`` bits, as signed 64-bit numbers."""
    found = [sum(1 << b for b in places) for k in range(radius + 1) for places in combinations(range(bits), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def ball_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``src, dst`` between distinct fingerprints of column ``fp`` that connect all within ``radius`` bits.

    ``radius`` must be even: then all that meet at a variant of half the radius are within the radius.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be an even number of bits")
    variants = distinct.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in masks(radius // 2)])).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = variants.select("fp", before.alias("dst")).where("dst IS NOT NULL")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("dst"))) <= radius).select(F.col("fp").alias("src"), "dst").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the fingerprint and the smallest id reachable over links."""
    prints = stored(fingerprints(docs, shingle))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = stored(ball_links(classes.select("fp"), radius))
    linked = links.select(F.explode(F.array("src", "dst")).alias("fp")).distinct()
    roots = connected_components(links, linked, "fp", "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: bytes | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the shingles of UTF-8 bytes."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    grams, total = shingles(words, shingle)
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64, total))


def short_prints(hashes: np.ndarray) -> list[int]:
    """``SHORT`` unsigned 32-bit fingerprints of distinct shingle hashes."""
    least = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(low), HASHED):
        np.minimum(least, (FACTORS * low[None, a : a + HASHED]).min(axis=1), out=least)
    mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bits = (mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8)).view(">u4").tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct numbers; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def stage_prints(docs: DataFrame) -> DataFrame:
    """``doc_id, words, prints`` of every row: a hash of all words and the short fingerprints."""

    def run(batch):
        texts = batch.column(1).to_pylist()
        words = [xxhash.xxh64_intdigest(b" ".join((t or b"").lower().split()), SEED) for t in texts]
        signed = np.array(words, np.uint64).view(np.int64)
        return {"doc_id": batch.column(0), "words": signed, "prints": [short_prints(shingle_hashes(t)) for t in texts]}

    return map_batches(docs.select("doc_id", F.col("text").cast("binary")), run, "doc_id long, words long, prints array<long>")


def meetings(nodes: DataFrame) -> DataFrame:
    """``variant, node`` of ``nodes`` (``node, prints``) for every variant of a short fingerprint that several nodes reach."""
    flipped = F.array(*[F.lit(m) for m in masks(1, SHORT_BITS)])
    short = nodes.select("node", F.posexplode("prints").alias("k", "print"))
    keyed = short.select("node", (F.shiftleft(F.col("k").cast("long"), SHORT_BITS) + F.col("print")).alias("key"))
    variants = keyed.select("node", F.explode(F.transform(flipped, lambda m: F.col("key").bitwiseXOR(m))).alias("variant"))
    return apart(variants, "node")


def apart(groups: DataFrame, name: str) -> DataFrame:
    """Rows of the variants that hold different values of a column."""
    at = Window.partitionBy("variant")
    ends = groups.withColumn("_low", F.min(name).over(at)).withColumn("_high", F.max(name).over(at))
    return ends.where("_low < _high").drop("_low", "_high")


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``src, dst``) that agree in enough of their 256 bits."""
    prints = lambda end: nodes.select(F.col("node").alias(end), F.col("prints").alias(f"_{end}"))
    differ = F.aggregate(F.zip_with("_src", "_dst", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    return pairs.join(prints("src"), "src").join(prints("dst"), "dst").where(differ <= MOST_BITS).select("src", "dst")


def led(groups: DataFrame, leaders: int) -> DataFrame:
    """Distinct ``src, dst``: members of variants (``variant, node, root``) and the first ``leaders`` members of theirs."""
    at = Window.partitionBy("variant")
    place = F.row_number().over(at.orderBy("node"))
    first = F.collect_list(F.when(F.col("place") <= leaders, F.struct(F.col("node").alias("dst"), F.col("root").alias("_root")))).over(at)
    # each pair is named by its later member, and members that meet share many variants: rows are made distinct before they are paired
    listed = groups.withColumn("place", place).withColumn("_first", first)
    earlier = F.transform(F.filter("_first", lambda l: (l["dst"] < F.col("node")) & (l["_root"] != F.col("root"))), lambda l: l["dst"])
    met = listed.select(F.col("node").alias("src"), earlier.alias("_dst")).where(F.size("_dst") > 0).distinct()
    return met.select("src", F.explode("_dst").alias("dst")).distinct()


def similar_pairs(docs: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (ids ``src, dst``) of which two texts have the Jaccard similarity."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(ends, "doc_id", "left_semi").dropDuplicates()
    named = lambda end: texts.select(F.col("doc_id").alias(end), F.col("text").alias(f"_{end}"))

    def run(batch):
        src, dst = batch.column("_src").to_pylist(), batch.column("_dst").to_pylist()
        alike = [jaccard(shingle_hashes(a), shingle_hashes(b)) >= similarity for a, b in zip(src, dst, strict=True)]
        return {"src": batch.column("src"), "dst": batch.column("dst"), "alike": alike}

    both = pairs.join(named("src"), "src").join(named("dst"), "dst").select("src", "dst", "_src", "_dst")
    return map_batches(both, run, "src long, dst long, alike boolean").where("alike").select("src", "dst").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of all ends of ``links``."""
    return connected_components(links, links.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "root")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` for every row with an id: the smallest id reachable over pairs of that similarity."""
    named = docs.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    prints = stored(stage_prints(named))
    classes = stored(prints.groupBy("words").agg(F.min("doc_id").alias("node"), F.first("prints").alias("prints")))
    nodes = classes.select("node", "prints")
    groups = stored(meetings(nodes))
    # one pair of each text first: the least of the first members of all its variants
    lead = groups.withColumn("dst", F.min("node").over(Window.partitionBy("variant")))
    pairs = stored(agreeing(lead.where("dst < node").groupBy(F.col("node").alias("src")).agg(F.min("dst").alias("dst")), nodes))
    tested, links, leaders = pairs, similar_pairs(named, pairs, similarity), 1
    while True:
        links = stored(links)
        roots = stored(components(links))
        rooted = groups.select("variant", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        groups = stored(apart(rooted.groupBy("variant", "root").agg(F.min("node").alias("node")), "root"))
        if groups.isEmpty():
            break
        pairs = stored(agreeing(led(groups, leaders).join(tested, ["src", "dst"], "left_anti"), nodes))
        tested, links = tested.unionByName(pairs), links.unionByName(similar_pairs(named, pairs, similarity))
        size = F.count(F.lit(1)).over(Window.partitionBy("variant"))
        groups = groups.withColumn("_size", size).where(F.col("_size") > leaders).drop("_size")
        leaders *= 8
    joined = classes.join(roots, "node", "left").select("words", F.coalesce("root", "node").alias("component_id"))
    return prints.join(joined, "words").select("doc_id", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(docs: DataFrame, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; one row for an id that repeats.

    Components are those of ``near_copies`` if ``similarity`` is given, else those of fingerprints within ``radius``.
    Rows with a null id stay: nothing names the document that should stand for them.
    """
    found = near_duplicates(docs, radius) if similarity is None else near_copies(docs, similarity)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    held = docs.where("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in docs.columns if c != "doc_id"])
    one = held.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")
    return one.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
