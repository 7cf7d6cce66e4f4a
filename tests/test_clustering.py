"""Graph, label and pruning steps against brute force."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dawnpress.operators import clustering as K
from dawnpress.operators import labels as L
from dawnpress.operators.graph import connected_components


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.range(200).select(F.col("id").alias("item_id"))
    got = connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"), nodes).collect()
    assert {r.item_id: r.component for r in got} == {i: find(i) for i in range(200)}


def label_pool(seed):
    rng = random.Random(seed)
    base = ["market rally continues", "storm hits northern coast", "election result disputed", "chip maker earnings beat"]
    out = set(base)
    for _ in range(60):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(s))
            rng.choice([lambda: s.pop(at), lambda: s.insert(at, rng.choice("abcxyz")), lambda: s.__setitem__(at, "q")])()
        out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("seed,threshold", [(0, 0.92), (1, 0.85)])
def test_labels(spark, seed, threshold):
    names = label_pool(seed)
    df = spark.createDataFrame([(n,) for n in names], "label string")
    ordered = sorted(names, key=lambda s: (-len(s), s))
    pairs, canon, mapping = set(), [], {}
    for i, later in enumerate(ordered):
        for earlier in ordered[:i]:
            if SequenceMatcher(None, later, earlier).ratio() >= threshold:
                pairs.add((later, earlier))
        best, top = None, 0.0
        for c in canon:
            score = SequenceMatcher(None, later, c).ratio()
            if score > top:
                best, top = c, score
        if best is not None and top >= threshold:
            mapping[later] = best
        else:
            canon.append(later)
            mapping[later] = later
    assert {(r.later, r.earlier) for r in L.similar_labels(df, threshold).collect()} == pairs
    assert {r.label: r.canonical for r in L.merge_labels(df, threshold).collect()} == mapping


@pytest.mark.parametrize("task_rows", [100, 5])
def test_prune(spark, task_rows):
    rng = np.random.default_rng(4)
    units, want = [], set()
    for cluster in range(3):
        dense = rng.random((9, 6)) * (rng.random((9, 6)) < 0.35)
        dense[:, 0] += 0.05
        dense /= np.linalg.norm(dense, axis=1, keepdims=True)
        alive = list(range(9))
        while len(alive) >= 3:
            sims = dense[alive] @ dense[alive].T
            mean = np.round((sims.sum(axis=1) - np.diag(sims)) / (len(alive) - 1), 12)
            if mean.min() >= 0.45:
                break
            alive.pop(int(mean.argmin()))
        if len(alive) >= 3:
            want |= {(cluster, cluster * 100 + i) for i in alive}
        units += [(cluster, cluster * 100 + i, f"t{j}", float(dense[i, j])) for i in range(9) for j in range(6) if dense[i, j]]
    df = spark.createDataFrame(units, "cluster_id bigint, item_id bigint, token string, w double")
    members = df.select("cluster_id", "item_id").distinct()
    got = K.prune_by_titles(members, df.drop("cluster_id"), 0.45, 3, task_rows=task_rows).collect()
    assert {(r.cluster_id, r.item_id) for r in got} == want


def test_pairs_above(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(23, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cluster_id bigint, vec array<double>")
    got = {(r.src, r.dst) for r in K.pairs_above(df, "cluster_id", 1.0, tile=5).collect()}
    assert got == {(i, j) for i in range(23) for j in range(i + 1, 23) if v[i] @ v[j] >= 1.0}


def test_quotas():
    assert K.parse_quotas("ai=2, other=0") == {"ai": 2, "other": 0}
    with pytest.raises(ValueError):
        K.parse_quotas("ai")


def test_random_index_vectors_are_unit(spark):
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c")], "item_id bigint, token string")
    rows = {r.item_id: np.array(r.vec) for r in K.random_index_vectors(terms, 3).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 and len(v) == 256 for v in rows.values())
    assert rows[1] @ rows[2] > abs(rows[1] @ rows[3])


@pytest.mark.parametrize("threshold", [0.55, 0.8])
def test_similar_labels_loses_no_pair(spark, threshold):
    rng = random.Random(threshold)
    names = {"".join(rng.choice("abé ") for _ in range(rng.randint(1, 14))) for _ in range(150)}
    for name in sorted(names)[:40]:  # edits at both ends and in the middle, also of long labels
        long = name * 4
        at = rng.randrange(len(long))
        names |= {long, "ba" + long, long + "é", long[:at] + "b" + long[at + 1 :], long[1:], long[:at] + "aé" + long[at:]}
    ordered = sorted(names, key=lambda s: (-len(s), s))
    want = {(b, a) for i, b in enumerate(ordered) for a in ordered[:i] if SequenceMatcher(None, b, a).ratio() >= threshold}
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("",), ("General",)], "label string")
    got = [(r.later, r.earlier) for r in L.similar_labels(df, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_clusters_of_thousands_are_pruned_inside_one_task(spark, monkeypatch):
    from dawnpress.operators import clustering

    def rounds(*_):
        raise AssertionError("one member a round")

    monkeypatch.setattr(clustering, "title_similarity", rounds)
    # 2,300 members of one title, 200 alone with theirs and 3 without any
    rows = [(i, "a", 0.8) for i in range(2300)] + [(i, "b", 0.6) for i in range(2300)] + [(i, f"t{i}", 1.0) for i in range(2300, 2500)]
    units = spark.createDataFrame(rows, "item_id bigint, token string, w double")
    members = spark.range(2503).selectExpr("bigint(0) AS cluster_id", "id AS item_id")
    kept = clustering.prune_by_titles(members, units, min_mean=0.5)
    assert sorted(r.item_id for r in kept.collect()) == list(range(2300))


def test_labels_that_share_pieces_only_are_no_candidates():
    rng = random.Random(3)
    names = ["the " + "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(7)) for _ in range(400)]
    keys = L._label_keys(0.85)
    rows = pd.DataFrame({"id": range(len(names)), "low": names, "n": [len(n) for n in names]})
    made = pd.concat(list(keys(iter([rows]))))
    assert len(made) < 100 * len(names)
    met = made.merge(made, on="key")
    met = met[met.id_x < met.id_y]
    # by pieces of three characters all 400 labels with the same first word met each other
    assert len(met) < 0.2 * len(names) ** 2 / 2
    marks = [bin(int(a) ^ int(b)).count("1") for a, b in zip(met.marks_x, met.marks_y)]
    left = met[[m <= n + k - 2 * c for m, n, k, c in zip(marks, met.n_x, met.n_y, met.common_x)]]
    assert len(left) < 0.01 * len(names) ** 2 / 2


@pytest.mark.parametrize(("seed", "gate"), [(0, -0.1), (1, 0.3), (2, 0.0)])
def test_gated_pairs(spark, seed, gate):
    """Pairs against brute force, items of two rows included; the links have the same components in fewer rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(90):
        vec = None if i % 29 == 28 else [float(rng.choice([-1, 0, 1])) if seed == 2 else rng.gauss(0.4, 1) for _ in range(4)]
        entities = [f"e{rng.randrange(12)}" for _ in range(rng.randrange(6))]
        grams = [f"g{rng.randrange(25)}" for _ in range(rng.randrange(7))]
        rows.append((i, vec, rng.choice(["politics", "sports", None]), entities, grams))
    rows += [(row[0], row[1], "sports", row[3], row[4]) for row in rows[:5]]
    features = spark.createDataFrame(rows, "item_id long, vec array<float>, category string, entities array<string>, ngrams array<string>").cache()
    members = spark.createDataFrame([(i % 2, i) for i in range(90)], "cluster_id long, item_id long")
    held = features.select("item_id", F.explode("entities").alias("entity"))
    frequency = K.document_frequency(held, "entity")
    common = {r.entity for r in frequency.collect() if np.log((95 + 1) / (r.df + 1)) + 1 < 2.2}
    want = []
    first = {row[0]: row for row in reversed(rows)}
    for a in range(90):
        for b in range(a + 2, 90, 2):
            x, y = first[a], first[b]
            e, g = len((set(x[3]) & set(y[3])) - common), len(set(x[4]) & set(y[4]))
            kinds = [[row[2] for row in rows if row[0] == i] for i in (a, b)]
            enough = sum(e >= (3 if "politics" in (p, q) else 2) or g >= 2 for p in kinds[0] for q in kinds[1])
            near = x[1] is not None and y[1] is not None and sum(np.float64(np.float32(p)) * np.float64(np.float32(q)) for p, q in zip(x[1], y[1], strict=True)) >= gate
            want += [(a, b)] * (enough * near * len(kinds[0]) * len(kinds[1]))
    call = lambda **more: K.gated_pairs(members, features, frequency, gate=gate, entity_idf=2.2, **more)
    assert sorted(tuple(r) for r in call().collect()) == sorted(want) and want
    groups = lambda pairs: sorted(tuple(r) for r in connected_components(pairs, members).collect())
    assert groups(call(links_only=True)) == groups(call())


def test_links_grow_with_the_items(spark):
    rows = [(i, [1.0, float(i % 7)], "sports", ["one", "two"], []) for i in range(1200)]
    rows += [(i, [1.0, 1.0], "sports", [], []) for i in range(1200, 40000)]
    features = spark.createDataFrame(rows, "item_id long, vec array<double>, category string, entities array<string>, ngrams array<string>")
    members = features.select(F.lit(1).cast("long").alias("cluster_id"), "item_id")
    frequency = K.document_frequency(features.select("item_id", F.explode("entities").alias("entity")), "entity")
    pairs = K.gated_pairs(members, features, frequency, gate=0.5)
    links = K.gated_pairs(members, features, frequency, gate=0.5, links_only=True)
    assert pairs.count() == 1200 * 1199 // 2 and links.count() < 4 * 1200


def test_a_large_cluster_is_pruned_without_a_round_per_member(spark, monkeypatch):
    """More members than one task used to hold: the same members stay as one by one, and no distributed round is needed."""
    from dawnpress.operators import clustering

    rounds = []
    monkeypatch.setattr(clustering, "title_similarity", lambda *a: rounds.append(1) or pytest.fail("a round for one member"))
    n = 120_000
    # two groups that share a token each, and members of their own that share nothing
    rows = spark.range(n).select(F.col("id").alias("item_id"), F.when(F.col("id") < n - 600, F.concat(F.lit("g"), F.col("id") % 2)).otherwise(F.concat(F.lit("own"), F.col("id"))).alias("token"), F.lit(1.0).alias("w"))
    kept = clustering.prune_by_titles(rows.select(F.lit(1).cast("bigint").alias("cluster_id"), "item_id"), rows, min_mean=0.2)
    assert not rounds and kept.agg(F.count("*"), F.max("item_id")).first()[:] == (n - 600, n - 601)


@pytest.mark.parametrize("seed", range(4))
def test_peel_equals_one_by_one(seed):
    from dawnpress.operators.clustering import peel

    rng = np.random.default_rng(seed)
    n, words = (40, 12) if seed < 3 else (3000, 900)
    cells = np.unique(rng.integers(0, n * words, n * 3))
    item, token = np.divmod(cells, words)
    w = rng.integers(1, 4, len(cells)) / 4
    dense = np.zeros((n, words))
    dense[item, token] = w
    similar = dense @ dense.T
    np.fill_diagonal(similar, 0)
    alive, limit = list(range(n)), float(np.quantile(similar.sum(1) / (n - 1), 0.7 if seed < 3 else 0.2))
    dots = similar.sum(1)
    while len(alive) >= 3:
        means = np.round(dots[alive] / max(1, len(alive) - 1), 12)
        worst = int(np.argmin(means))
        if means[worst] >= limit or len(alive) <= 2:
            break
        dots -= similar[alive.pop(worst)]
    assert peel(item, token, w, n, limit, 3).tolist() == alive
