"""Story and event clustering on assignment tables (cluster_id, item_id)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from dawnpress.functions import numeric as N
from dawnpress.functions import text as T
from dawnpress.functions import vectors as V
from dawnpress.functions import wordlists as W
from dawnpress.operators.frames import first_per_key, top_per_key
from dawnpress.operators.graph import connected_components, sized_components
from dawnpress.operators.overlap import Lists, Tile, judged_in_tiles, linked_by_terms, ordered_terms, shared_in, sharing_pairs, spanning
from dawnpress.operators.retrieval import _tiles
from dawnpress.session import cut_lineage

# --- document frequencies and vectors --------------------------------------------------------------------------------


def document_frequency(terms: DataFrame, term: str = "token") -> DataFrame:
    """Documents per term of (item_id, term) rows."""
    return terms.select("item_id", term).distinct().groupBy(term).agg(F.count(F.lit(1)).alias("df"))


def term_weights(terms: DataFrame, documents: int | Column, term: str = "token") -> DataFrame:
    """Damped term frequency times inverse document frequency of (item_id, term) rows with repetitions."""
    counts = terms.groupBy("item_id", term).agg(F.count(F.lit(1)).alias("c"))
    df = counts.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    weight = N.damped_count(F.col("c")) * N.inverse_frequency(F.lit(documents) if isinstance(documents, int) else documents, F.col("df"))
    return counts.join(df, term).select("item_id", term, weight.alias("w"))


def unit_weights(weights: DataFrame, term: str = "token") -> DataFrame:
    lengths = weights.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_len"))
    return weights.join(lengths, "item_id").where("_len > 1e-12").select("item_id", term, (F.col("w") / F.col("_len")).alias("w"))


def random_index_vectors(terms: DataFrame, documents: int, dim: int = 256, spread: int = 10, salt: int = 1337) -> DataFrame:
    """Hashed random-index embedding: each term adds its weight with a sign to ``spread`` dimensions; unit length.

    The sums per (item, dimension) combine before the shuffle, so at most ``dim`` numbers per item travel.
    """
    weights = term_weights(terms, documents)
    parts = weights.select("item_id", "token", "w", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_i"))
    h = F.md5(F.concat_ws("|", F.lit(str(salt)), "token", F.col("_i").cast("string")))
    place = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim
    signed = parts.select("item_id", place.alias("_d"), F.when(F.substring(h, 9, 1) < "8", -F.col("w")).otherwise(F.col("w")).alias("_x"))
    summed = signed.groupBy("item_id", "_d").agg(F.sum("_x").alias("_x"))
    packed = summed.groupBy("item_id").agg(F.collect_list(F.struct("_d", "_x")).alias("_m"))
    return packed.select("item_id", _dense_unit("_m._d", "_m._x", F.lit(dim)).alias("vec"))


@F.pandas_udf(ArrayType(DoubleType()))
def _dense_unit(places: pd.Series, values: pd.Series, dim: pd.Series) -> pd.Series:
    rows = np.repeat(np.arange(len(places)), places.map(len).to_numpy())
    dense = np.zeros((len(places), int(dim.iloc[0]) if len(dim) else 0))
    if len(rows):
        dense[rows, np.concatenate(places.to_list()).astype(np.int64)] = np.concatenate(values.to_list())
    lengths = np.linalg.norm(dense, axis=1, keepdims=True)
    return pd.Series(list(dense / np.where(lengths > 1e-12, lengths, 1.0)))


def embedding_terms(items: DataFrame, entity_weight: float = 2.2, with_summary: bool = False) -> DataFrame:
    """(item_id, token) rows: text tokens plus boosted entity tokens of the raw headline and the entity column."""
    text = F.concat_ws(" ", "headline", "summary") if with_summary else F.col("headline")
    boost = max(1, round(entity_weight))
    key = T.entity_slug(F.col("entity_key"))
    entities = F.array_distinct(F.concat(T.entities_strict(F.col("raw_headline")), F.when(key.isNotNull(), F.array(key)).otherwise(F.array())))
    boosted = F.flatten(F.array_repeat(F.transform(entities, lambda e: F.concat(F.lit("ent_"), e)), boost))
    return items.select("item_id", F.explode(F.concat(T.tokenize(text), boosted)).alias("token"))


def clusters_of_size(members: DataFrame, min_size: int) -> DataFrame:
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return members.join(sizes.select("cluster_id"), "cluster_id")


def centroids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Unit mean vector per cluster, summed dimension-wise before the shuffle."""
    spread = members.join(vectors, "item_id").select("cluster_id", F.posexplode("vec").alias("_d", "_x"))
    sums = spread.groupBy("cluster_id", "_d").agg(F.sum(F.col("_x").cast("double")).alias("_s"))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("_d", "_s"))), lambda x: x["_s"])
    return sums.groupBy("cluster_id").agg(packed.alias("_c")).select("cluster_id", V.normalize(F.col("_c")).alias("centroid"))


def member_similarity(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster_id, item_id, similarity to the centroid)."""
    joined = members.join(vectors, "item_id").join(centroids(members, vectors), "cluster_id")
    return joined.select("cluster_id", "item_id", V.dot(F.col("vec"), F.col("centroid")).alias("similarity"))


def cohesion(members: DataFrame, vectors: DataFrame) -> DataFrame:
    return (
        member_similarity(members, vectors)
        .groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("size"), F.avg("similarity").alias("cohesion"))
    )


# --- entity graph ----------------------------------------------------------------------------------------------------


def rare_terms(rows: DataFrame, total: int | Column, min_idf: float, term: str = "entity") -> DataFrame:
    """Terms of at least two items whose inverse frequency in ``total`` items reaches ``min_idf``; rarity follows the corpus."""
    df = rows.select("item_id", term).distinct().groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    documents = F.lit(total) if isinstance(total, int) else total
    return df.where((F.col("df") >= 2) & (N.inverse_frequency(documents, F.col("df")) >= min_idf)).select(term)


def rare_entities(entities: DataFrame, min_idf: float = 4.5, total: int | None = None) -> DataFrame:
    """Distinct (item_id, entity) rows of rare entities.

    An entity is rare if its inverse frequency among ``total`` items (those with entities, if not given) reaches ``min_idf``:
    4.5 is some three in a hundred items, in a corpus of any size.
    """
    once = entities.select("item_id", "entity").distinct()
    documents = once.select("item_id").distinct().count() if total is None else total
    return once.join(rare_terms(once, documents, min_idf), "entity").select("item_id", "entity")


def shared_entity_pairs(entities: DataFrame, min_idf: float = 4.5, min_shared: int = 2, total: int | None = None) -> DataFrame:
    """Item pairs ``a < b`` that share at least ``min_shared`` rare entities, and how many they share."""
    return sharing_pairs(rare_entities(entities, min_idf, total), min_shared, term="entity")


def shared_entity_links(entities: DataFrame, min_idf: float = 4.5, min_shared: int = 2, total: int | None = None) -> DataFrame:
    """(src, dst) with the components of ``shared_entity_pairs``, in rows that grow with the items and not with their pairs."""
    return linked_by_terms(rare_entities(entities, min_idf, total), min_shared, term="entity")


def headline_entities(items: DataFrame, raw: str = "raw_headline") -> DataFrame:
    return items.select("item_id", F.explode(T.entities_lenient(F.col(raw))).alias("entity"))


def entity_graph_clusters(items: DataFrame, min_size: int = 3, **limits: float) -> DataFrame:
    """Event clusters: components of the shared-rare-entity graph, as (cluster_id, item_id, size)."""
    edges = cut_lineage(shared_entity_links(headline_entities(items), total=items.count(), **limits))
    linked = edges.select(F.col("src").alias("item_id")).unionByName(edges.select(F.col("dst").alias("item_id")))
    labelled = connected_components(edges, linked if min_size > 1 else items)
    return sized_components(labelled, min_size).withColumnRenamed("component", "cluster_id")


# --- refining clusters -----------------------------------------------------------------------------------------------


def gated_pairs(
    members: DataFrame,
    features: DataFrame,
    frequency: DataFrame,
    gate: float = 0.58,
    min_entities: int = 2,
    min_entities_politics: int = 3,
    min_ngrams: int = 2,
    entity_idf: float = 4.2,
    total: int | None = None,
    links_only: bool = False,
) -> DataFrame:
    """Pairs inside a cluster that may stay together: similar vectors and shared rare entities or n-grams.

    ``features`` is (item_id, vec, category, entities, ngrams), ``frequency`` (entity, df) among ``total`` items (the number of
    ``features``, if not given). Entities whose inverse frequency reaches ``entity_idf`` and n-grams of ``features`` count as shared;
    of each item's only the rarest propose pairs (``overlap``). Vectors travel with the items, so pairs are judged where they meet.
    With ``links_only`` all pairs are judged, but of those of a tile only so many are returned that the same items hang together:
    rows that grow with the items and have the components of all pairs.
    """
    total = features.count() if total is None else total
    rare = frequency.where(N.inverse_frequency(F.lit(total), F.col("df")) >= entity_idf).select("entity")
    located = members.join(features, "item_id")
    ent = located.select("cluster_id", "item_id", F.explode(F.array_distinct("entities")).alias("term"))
    ent = ent.join(rare.withColumnRenamed("entity", "term"), "term", "left_semi")
    grams = located.select("cluster_id", "item_id", F.explode(F.array_distinct("ngrams")).alias("term"))

    # an item of several rows pairs each of them: _rows of the item, _plain of them not about politics
    plain = F.when(F.col("category") == "politics", 0).otherwise(1)
    kinds = features.groupBy("item_id").agg(F.count(F.lit(1)).alias("_rows"), F.sum(plain).alias("_plain"))
    usable = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    judged = features.where(usable).select("item_id", "vec").join(kinds, "item_id")
    by_entity = cut_lineage(ordered_terms(ent, min_entities, ["cluster_id"]))
    by_gram = cut_lineage(ordered_terms(grams, min_ngrams, ["cluster_id"]))
    held = by_entity.withColumnRenamed("terms", "entities")
    by_gram = by_gram.join(held, ["cluster_id", "item_id"], "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<bigint>")))
    strict = max(min_entities, min_entities_politics)

    def prepare(found_by_gram: bool):
        def prepared(rows: pa.Table):
            near = _gate(rows, gate)
            count, plain = rows["_rows"].to_numpy(), rows["_plain"].to_numpy()
            entities = Lists(rows["entities"]) if found_by_gram and not links_only else None

            def judge(tile: Tile) -> Sequence[np.ndarray] | None:
                left, right = tile.left, tile.right
                fresh = tile.fresh & (tile.shared >= (min_ngrams if found_by_gram else min_entities))
                if not fresh.any():
                    return None
                all_of, plain_of = np.multiply.outer(count[left], count[right]), np.multiply.outer(plain[left], plain[right])
                by_entities = lambda shared: np.where(shared >= strict, all_of, np.where(shared >= min_entities, plain_of, 0))
                if not found_by_gram:
                    times = by_entities(tile.shared)
                else:  # what the entities have not given
                    times = all_of - by_entities(shared_in(entities, left, right)) if entities else all_of
                chosen = fresh & (times > 0)
                if not chosen.any():
                    return None
                chosen &= near(left, right, chosen)
                src, dst, places = tile.pairs(spanning(chosen) if links_only else chosen)
                often = 1 if links_only else times[places]
                return np.repeat(src, often), np.repeat(dst, often)

            return judge

        return prepared

    kind = members.join(features, "item_id").schema["item_id"].dataType.simpleString()
    schema = f"src {kind}, dst {kind}"
    with_vectors = lambda sets: sets.drop("cluster_id").join(judged, "item_id")
    pairs = judged_in_tiles(with_vectors(by_entity), min_entities, prepare(False), schema)
    return pairs.unionByName(judged_in_tiles(with_vectors(by_gram), min_ngrams, prepare(True), schema))


def _gate(rows: pa.Table, gate: float):
    """Whether products of the vectors of some rows reach ``gate``, as ``V.dot`` adds them up; NaN counts as large."""
    lists = Lists(rows["vec"], np.float64)
    widest = int(lists.sizes.max(initial=0))
    vec = np.zeros((len(lists.sizes), widest))
    vec[np.arange(widest) < lists.sizes[:, None]] = lists.values
    length = (vec * vec).sum(1)

    def near(left: slice, right: slice, asked: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            product = vec[left] @ vec[right].T
            slack = 1e-9 * max(1.0, abs(gate), float(length[left].max()), float(length[right].max()))
            unsure = asked & ~(np.abs(product - gate) > slack)
            i, j = np.nonzero(unsure)
            for at in range(0, len(i), 100_000):  # rounding may decide: add up in order
                x, y = vec[left][i[at : at + 100_000]], vec[right][j[at : at + 100_000]]
                product[i[at : at + 100_000], j[at : at + 100_000]] = np.add.accumulate(x * y, axis=1)[:, -1] if widest else 0.0
            return ~(product < gate) & (lists.sizes[left][:, None] == lists.sizes[right])

    return near


def split_clusters(members: DataFrame, pairs: DataFrame, min_size: int) -> DataFrame:
    """Components of the gated pairs inside each cluster; the smallest item names the new cluster."""
    labelled = connected_components(pairs, members)
    return sized_components(labelled, min_size).select(F.col("component").alias("cluster_id"), "item_id")


def peel(item: np.ndarray, token: np.ndarray, w: np.ndarray, count: int, min_mean: float, min_size: int) -> np.ndarray:
    """Positions that stay of ``count`` items with (item, token, w) weights, in order of items, when the one with the lowest mean goes again and again.

    Means share their divisor, so the lowest product finds them; only what may round to the same mean is divided. Arrays shrink with the items.
    """
    names, left = np.arange(count), count
    dot = np.bincount(item, w * np.bincount(token, w)[token], count) - np.bincount(item, w * w, count) if len(item) else np.zeros(count)
    alive, of_item = np.ones(count, bool), None
    while left >= max(1, min_size):
        if of_item is None or (len(names) > 1024 and 2 * left < len(names)):
            stays = alive[item]
            place = np.cumsum(alive) - 1
            item, token, w = place[item[stays]], np.unique(token[stays], return_inverse=True)[1], w[stays]
            names, dot, alive = names[alive], dot[alive], np.ones(left, bool)
            # once ordered by item and once by token
            of_item = np.searchsorted(item, np.arange(left + 1))
            by_token = np.argsort(token, kind="stable")
            of_token = np.searchsorted(token[by_token], np.arange(int(token.max(initial=-1)) + 2))
            holders, held = item[by_token], w[by_token]
        scale = max(1, left - 1)
        low = dot.min()
        near = np.flatnonzero(dot <= low + 2e-12 * scale + 1e-15 * abs(low))
        mean = np.round(dot[near] / scale, 12)
        worst = int(near[np.argmin(mean)])
        if mean.min() >= min_mean or left <= 2:
            break
        alive[worst], left = False, left - 1
        for k in range(of_item[worst], of_item[worst + 1]):  # only items that share a token lose something
            same = slice(of_token[token[k]], of_token[token[k] + 1])
            dot[holders[same]] -= w[k] * held[same]
        dot[worst] = np.inf
    return names[alive]


def prune_by_titles(
    members: DataFrame, unit_titles: DataFrame, min_mean: float = 0.10, min_size: int = 3, task_rows: int = 1_000_000
) -> DataFrame:
    """Repeatedly drop the member with the lowest mean title similarity until every member reaches ``min_mean``.

    The mean similarity to the others follows from the cluster's summed title vector, so no pairs are built. Clusters of
    at most ``task_rows`` members finish inside one task, which holds their weights as numbers (tokens as 64-bit hashes) and takes from the
    others only what they share with the member that leaves; larger ones shrink in distributed rounds until they fit or are done.
    """
    current = cut_lineage(members.select("cluster_id", "item_id"))
    finished = None
    while True:
        sizes = current.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
        large = sizes.where((F.col("size") > task_rows) & (F.col("size") >= min_size))
        if large.isEmpty():
            break
        big = current.join(large, "cluster_id")
        means = title_similarity(big.select("cluster_id", "item_id"), unit_titles)
        means = means.withColumn("mean_similarity", F.round("mean_similarity", 12))  # as inside one task
        worst = first_per_key(means, ["cluster_id"], ["mean_similarity", "item_id"])
        failing = cut_lineage(worst.where(F.col("mean_similarity") < min_mean).select("cluster_id", "item_id"))
        done = big.join(failing.select("cluster_id"), "cluster_id", "left_anti").select("cluster_id", "item_id")
        finished = done if finished is None else finished.unionByName(done)
        finished = cut_lineage(finished)
        current = cut_lineage(
            current.join(finished.select("cluster_id").distinct(), "cluster_id", "left_anti").join(failing, ["cluster_id", "item_id"], "left_anti")
        )
    rows = current.join(unit_titles, "item_id", "left")
    rows = rows.select("cluster_id", "item_id", F.when(F.col("token").isNotNull(), F.xxhash64("token")).alias("token"), "w")

    def prune(table: pa.Table) -> pa.Table:
        item_ids, words, weights = (table.column(c) for c in ("item_id", "token", "w"))
        items, positions = np.unique(item_ids.to_numpy(), return_inverse=True)
        known = words.is_valid().to_numpy()
        tokens, columns = np.unique(words.drop_null().to_numpy(), return_inverse=True)
        # the weights as triples
        cells, first = np.unique(positions[known] * max(1, len(tokens)) + columns, return_index=True)
        item, token = np.divmod(cells, max(1, len(tokens)))
        alive = peel(item, token, weights.to_numpy()[known][first], len(items), min_mean, min_size)
        kept = items[alive] if len(alive) >= min_size else items[:0]
        cluster = pa.chunked_array([table.column("cluster_id").slice(0, 1).combine_chunks()]).take(pa.array(np.zeros(len(kept), np.int64)))
        return pa.table([cluster, pa.array(kept)], ["cluster_id", "item_id"])

    small = rows.groupBy("cluster_id").applyInArrow(prune, "cluster_id bigint, item_id bigint")
    return small if finished is None else small.unionByName(finished.select(small.columns))


def title_similarity(members: DataFrame, unit_titles: DataFrame) -> DataFrame:
    """Mean cosine of each member's title with the other members' titles."""
    rows = members.join(unit_titles, "item_id")
    sums = rows.groupBy("cluster_id", "token").agg(F.sum("w").alias("_s"))
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    dots = (
        rows.join(sums, ["cluster_id", "token"])
        .groupBy("cluster_id", "item_id")
        .agg(F.sum(F.col("w") * (F.col("_s") - F.col("w"))).alias("_dot"))
    )
    return (
        members.join(sizes, "cluster_id")
        .join(dots, ["cluster_id", "item_id"], "left")
        .select(
            "cluster_id",
            "item_id",
            (F.coalesce("_dot", F.lit(0.0)) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("mean_similarity"),
        )
    )


def pairs_above(vectors: DataFrame, key: str, threshold: float, tile: int = 2048) -> DataFrame:
    """Pairs (src < dst) of rows whose vectors' dot product reaches the threshold, one tile product at a time."""
    packed, tiles = _tiles(vectors.select(key, "vec"), key, tile, vectors.count(), "q")
    other = packed.select(F.col("q_tile").alias("r_tile"), F.col("q").alias("r"))
    both = packed.withColumn("r_tile", F.explode(F.sequence(F.col("q_tile"), F.lit(tiles - 1).cast("bigint")))).join(other, "r_tile")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, r in zip(batch["q"], batch["r"]):
                a, b = np.array([x["id"] for x in q]), np.array([x["id"] for x in r])
                dots = np.round(np.array([x["vec"] for x in q]) @ np.array([x["vec"] for x in r]).T, 12)
                i, j = np.nonzero(dots >= threshold)
                low, high = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
                yield pd.DataFrame({"src": low, "dst": high, "score": dots[i, j]}).query("src < dst").drop_duplicates()

    return both.select("q", "r").mapInPandas(near, "src bigint, dst bigint, score double")


def merge_clusters(
    members: DataFrame, vectors: DataFrame, entities: DataFrame, merge_sim: float = 0.85, min_shared: int = 1
) -> DataFrame:
    """Join clusters with near centroids that share entities; the smallest cluster id names the result.

    Pairs are proposed by shared entities and only theirs are multiplied. Without a condition on entities (``min_shared`` 0) all
    centroids are, tile by tile.
    """
    centre = cut_lineage(centroids(members, vectors).select("cluster_id", F.col("centroid").alias("vec")))
    if min_shared > 0:
        sets = members.join(entities, "item_id").select(F.col("cluster_id").alias("item_id"), "entity")
        proposed = sharing_pairs(sets, min_shared, term="entity").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        side = lambda end: centre.select(F.col("cluster_id").alias(end), F.col("vec").alias(f"_{end}"))
        both = proposed.join(side("src"), "src").join(side("dst"), "dst")
        pairs = both.where(F.round(V.dot(F.col("_src"), F.col("_dst")), 12) >= merge_sim)
    else:
        pairs = pairs_above(centre, "cluster_id", merge_sim)
    groups = connected_components(pairs.select("src", "dst"), members, "cluster_id", "merged")
    return members.join(groups, "cluster_id").select(F.col("merged").alias("cluster_id"), "item_id").distinct()


# --- cluster objects -------------------------------------------------------------------------------------------------


def cluster_cores(
    members: DataFrame, items: DataFrame, vectors: DataFrame, now: Column, min_size: int = 3, min_cohesion: float = 0.60
) -> DataFrame:
    """One row per cohesive cluster: scalars, representative, top entities, key facts, supporting articles.

    Lists hold 15, 7 and 10 entries: rows are cut to those ranks before they are collected.
    """
    near = cut_lineage(member_similarity(members, vectors))
    stats = near.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.avg("similarity").alias("cohesion"))
    stats = stats.where((F.col("size") >= min_size) & (F.col("cohesion") >= min_cohesion))
    described = near.join(stats.select("cluster_id"), "cluster_id", "left_semi").join(items, "item_id")
    return _objects(described.withColumn("_order", -F.col("similarity")), stats, now)


def event_objects(members: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Cluster objects of the event method: the newest article represents, undated ones count as now."""
    stats = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).withColumn("cohesion", F.lit(None).cast("double"))
    newest = F.unix_micros(F.coalesce(F.col("published_utc"), now))
    described = members.select("cluster_id", "item_id").join(items, "item_id").withColumn("_order", -newest)
    return _objects(described, stats, now, undated_is_now=True)


def _objects(described: DataFrame, stats: DataFrame, now: Column, undated_is_now: bool = False) -> DataFrame:
    source = T.article_source(F.col("topic_name"), F.col("link"))
    rows = described.withColumn("_source", source).withColumn(
        "_category", F.col("category") if "category" in described.columns else T.category(F.concat_ws(" ", "headline", "summary"))
    )
    modes = rows.groupBy("cluster_id", "_category").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"))
    mode = first_per_key(modes, ["cluster_id"], [F.desc("_n"), F.asc("_first")]).select("cluster_id", F.col("_category").alias("topic_category"))
    published = F.coalesce(F.col("published_utc"), now) if undated_is_now else F.col("published_utc")
    age = N.hours_between(now, F.max(published)) / 24
    facts = rows.groupBy("cluster_id").agg(
        F.countDistinct("_source").alias("source_diversity"), F.coalesce(age, F.lit(9999.0)).alias("age_days")
    )
    extract = T.entities_lenient if undated_is_now else T.entities_strict
    named = rows.select("cluster_id", F.explode(extract(F.col("raw_headline"))).alias("entity"))
    counted = named.groupBy("cluster_id", "entity").agg(F.count(F.lit(1)).alias("count"))
    best = top_per_key(counted, ["cluster_id"], [F.desc("count"), F.asc("entity")], 15, "_r")
    entities = best.groupBy("cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "entity", "count"))), lambda x: x.dropFields("_r")).alias("entities")
    )
    top = top_per_key(rows, ["cluster_id"], [F.asc("_order"), F.desc("item_id")], 10, "_place")
    article = F.struct(
        "_place",
        "headline",
        F.col("summary").alias("summary"),
        "link",
        F.date_format("published_utc", "yyyy-MM-dd'T'HH:mm:ss").alias("published_utc"),
        F.col("_source").alias("source"),
    )
    listed = top.groupBy("cluster_id").agg(F.sort_array(F.collect_list(article)).alias("_articles"))
    return (
        stats.join(mode, "cluster_id")
        .join(facts, "cluster_id")
        .join(entities, "cluster_id", "left")
        .join(listed, "cluster_id")
        .select(
            T.text_id(F.concat_ws("|", F.col("_articles")[0]["headline"], F.col("_articles")[0]["link"])).alias("story_id"),
            "cluster_id",
            "topic_category",
            F.col("size").cast("bigint").alias("size"),
            "cohesion",
            "source_diversity",
            "age_days",
            F.coalesce("entities", F.array().cast("array<struct<entity:string,count:bigint>>")).alias("entities"),
            F.struct(F.col("_articles")[0]["headline"].alias("headline"), F.col("_articles")[0]["summary"].alias("summary")).alias(
                "neutral_core_summary"
            ),
            F.filter(F.transform(F.slice("_articles", 1, 7), lambda a: a["headline"]), lambda h: h != "").alias("key_facts"),
            F.col("cohesion").alias("confidence_score"),
            F.transform("_articles", lambda a: a.dropFields("_place")).alias("supporting_articles"),
        )
    )


def with_bucket_and_score(cores: DataFrame) -> DataFrame:
    names = F.array_join(F.transform(F.slice("entities", 1, 10), lambda e: e["entity"]), " ")
    blob = F.concat_ws(" ", F.col("neutral_core_summary.headline"), names)
    return cores.withColumn("bucket", N.cluster_bucket(F.col("topic_category"), blob)).withColumn(
        "rank_score",
        N.cluster_score(F.col("size"), F.col("source_diversity"), F.coalesce("cohesion", F.lit(0.0)), F.col("age_days")),
    )


def parse_quotas(text: str) -> dict[str, int]:
    """``"ai=20,markets=8"`` -> quotas per bucket."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        if "=" not in part:
            raise ValueError(f"bad quota {part!r}: expected bucket=count")
        name, count = part.split("=", 1)
        out[name.strip()] = int(count.strip())
    return out


def select_by_quota(cores: DataFrame, quotas: Mapping[str, int] = W.STORY_QUOTAS, key: str = "story_id") -> DataFrame:
    """Best cores per bucket up to its quota, then the best of the rest up to the total.

    ``cores`` has key, bucket, rank_score. The result is bounded by the sum of the quotas.
    """
    wanted = sum(max(0, q) for q in quotas.values())
    quota = F.lit(0)
    for name, count in quotas.items():
        quota = F.when(F.col("bucket") == name, max(0, count)).otherwise(quota)
    by = [F.desc("rank_score"), F.asc(key)]
    # the literal limit lets Spark cut every task's rows before the shuffle
    best = top_per_key(cores, ["bucket"], by, max([0, *quotas.values()]), "_r")
    first = best.withColumn("_quota", quota).where(F.col("_r") <= F.col("_quota")).drop("_r", "_quota")
    first = first.withColumn("picked_by", F.lit("quota"))
    missing = first.agg(F.greatest(F.lit(wanted) - F.count(F.lit(1)), F.lit(0))).scalar()
    rest = cores.join(first.select(key), key, "left_anti").orderBy(*by).limit(wanted)
    placed = rest.withColumn("_r", F.row_number().over(Window.orderBy(*by))).where(F.col("_r") <= missing).drop("_r")
    return first.unionByName(placed.withColumn("picked_by", F.lit("fill")).select(first.columns))
