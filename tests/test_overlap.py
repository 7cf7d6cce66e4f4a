import random
from itertools import combinations

import numpy as np
import pytest
from dawnpress.operators import overlap
from dawnpress.operators.graph import connected_components


def drawn(seed, items=120, terms=60):
    draw = random.Random(seed)
    rows = []
    for item in range(items):
        for _ in range(draw.randrange(0, 7)):
            rows.append((item % 3, item, f"t{min(draw.randrange(terms), draw.randrange(terms))}"))
    return rows


def sets_of(rows):
    found = {}
    for group, item, term in rows:
        found.setdefault((group, item), set()).add(term)
    return found


@pytest.mark.parametrize(("k", "block"), [(1, 1024), (2, 1024), (2, 5), (3, 7)])
def test_pairs_equal_brute_force(spark, k, block):
    rows = drawn(k)
    want = {(a[1], b[1], len(x & y)) for (a, x), (b, y) in combinations(sorted(sets_of(rows).items(), key=lambda r: r[0][1]), 2) if a[0] == b[0] and len(x & y) >= k}
    df = spark.createDataFrame(rows, "cluster_id long, item_id long, term string")
    found = overlap.sharing_pairs(df, k, ["cluster_id"], block=block)
    assert {tuple(r) for r in found.collect()} == want and want


@pytest.mark.parametrize("k", [1, 2, 3])
def test_groups_are_those_of_pairs(spark, k):
    rows = [(0, item, term) for _, item, term in drawn(10 + k, items=80, terms=40 * k)]
    df = spark.createDataFrame([(i, t) for _, i, t in rows], "item_id long, term string").cache()
    pairs = overlap.sharing_pairs(df, k).selectExpr("a AS src", "b AS dst")
    labelled = lambda edges: sorted(tuple(r) for r in connected_components(edges, df).collect())
    assert labelled(overlap.linked_by_terms(df, k)) == labelled(pairs)


def test_a_term_of_all_items_makes_no_pairs(spark):
    """Rows of the stars grow with the items, not with their square."""
    rows = [(i, t) for i in range(3000) for t in ("everywhere", "also", f"own{i}")]
    df = spark.createDataFrame(rows, "item_id long, term string")
    assert overlap.term_sets(df, 2).count() == 3 * 3000
    assert overlap.linked_by_terms(df, 2).count() == 2999


def test_edges(spark):
    empty = spark.createDataFrame([], "item_id long, term string")
    assert overlap.linked_by_terms(empty, 2).count() == overlap.sharing_pairs(empty, 2).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "item_id long, term string")
    assert overlap.sharing_pairs(twice, 2).count() == overlap.linked_by_terms(twice, 2).count() == 0
    assert [tuple(r) for r in overlap.sharing_pairs(twice, 1).collect()] == [(1, 2, 1)]
    with pytest.raises(ValueError):
        overlap.term_sets(twice, 0)


def test_pairs_of_long_lists(spark, monkeypatch):
    """Items of many terms take part in no bucket, their pairs are found all the same."""
    monkeypatch.setattr(overlap, "LONG_TERMS", 3)
    rows = drawn(5)
    want = {(a[1], b[1], len(x & y)) for (a, x), (b, y) in combinations(sorted(sets_of(rows).items(), key=lambda r: r[0][1]), 2) if a[0] == b[0] and len(x & y) >= 2}
    found = overlap.sharing_pairs(spark.createDataFrame(rows, "cluster_id long, item_id long, term string"), 2, ["cluster_id"])
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and want


def test_pairs_are_judged_where_they_meet(spark):
    """No pair is shuffled: after the buckets are dealt, the plan neither exchanges, aggregates nor joins."""
    rows = [(i, t) for i in range(1500) for t in ("everywhere", "also", f"own{i // 2}")]
    found = overlap.sharing_pairs(spark.createDataFrame(rows, "item_id long, term string"), 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.split("\n")[0]
    assert found.count() == 1500 * 1499 // 2


@pytest.mark.parametrize("seed", range(4))
def test_matches_of_a_tile(seed):
    draw = np.random.default_rng(seed)
    left, right = [[draw.choice(9 if seed < 3 else 2, draw.integers(0, 3), replace=False) for _ in range(n)] for n in ((30, 20), (1, 2), (0, 4), (4000, 3500))[seed]]
    side = lambda lists: (np.concatenate([*lists, np.empty(0, int)]).astype(np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64))
    held = lambda lists: np.array([[v in x for v in range(9)] for x in lists], np.int64).reshape(len(lists), 9)
    shared = overlap.met_in(side(left), side(right), (len(left), len(right)))
    assert np.array_equal(shared, held(left) @ held(right).T)


@pytest.mark.parametrize("seed", range(3))
def test_spanning_links_keep_the_groups(seed):
    draw = np.random.default_rng(seed)
    linked = draw.random((25, 30)) < (0.02, 0.05, 0.5)[seed]

    def groups(matrix):
        label = np.arange(55)
        for _ in range(55):
            for i, j in zip(*np.nonzero(matrix), strict=True):
                label[i] = label[25 + j] = min(label[i], label[25 + j])
        return label.tolist()

    kept = overlap.spanning(linked)
    assert groups(kept) == groups(linked) and kept.sum() < 55 and not (kept & ~linked).any()
