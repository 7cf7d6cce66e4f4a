import math
import random

import pytest

from dawnpress.llm import projections

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, cosine=0.98):
    def sound(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def near(a, b):
        if a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        top = [max(map(abs, v)) for v in (a[1], b[1])]
        x, y = ([c / t for c in v] for v, t in zip((a[1], b[1]), top, strict=True))
        return sum(p * q for p, q in zip(x, y, strict=True)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)) >= cosine

    taking = [sound(v, label) for _, v, label in rows]
    linked = [[j for j in range(len(rows)) if j != i and taking[i] and taking[j] and near(rows[i], rows[j])] for i in range(len(rows))]
    found = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in linked[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        found.append((rows[i][0], len(linked[i]), component, rows[i][0] == component))
    return found


def planted(seed, dense=150):
    draw = random.Random(seed)
    gauss = lambda n, scale=1.0: [draw.gauss(0, scale) for _ in range(n)]
    base = [gauss(24) for _ in range(60)]
    rows = [(b, draw.randrange(3)) for b in base]
    for _ in range(200):
        v, label = rows[draw.randrange(len(rows))]
        noise = draw.choice([0.0, 0.01, 0.05, 0.1, 0.2, 0.3])
        rows.append(([x + e for x, e in zip(v, gauss(24, noise), strict=True)], label if draw.random() < 0.8 else draw.randrange(3)))
    rows += [([x + e for x, e in zip(base[0], gauss(24, 0.12), strict=True)], 1) for _ in range(dense)]
    draw.shuffle(rows)
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize(("window", "block", "tile"), [(512, 4096, 2048), (40, 64, 16)])
def test_equals_brute_force(spark, window, block, tile):
    rows = planted(window)
    want = brute(rows)
    assert max(r[1] for r in want) > 60 and sum(r[1] == 0 for r in want) > 20
    found = projections.near_vectors(spark.createDataFrame(rows, SCHEMA), passes=8, window=window, block=block, tile=tile)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (None, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1)]
    rows += [(8, [1.0, None, 3.0], 1), (9, [nan, 2.0, 3.0], 1), (10, [inf, 2.0, 3.0], 1), (11, [1.0, 2.0], 1), (12, [2e200, 4e200, 6e200], 1)]
    rows += [(13, [-1.0, -2.0, -3.0], 1), (14, [1e-200, 2e-200, 3e-200], 1), (15, [0.0, 1.0], 3), (16, [-0.0, 1.0], 3), (None, [5.0], 4)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", component_id int, node string")
    found = sorted((tuple(r) for r in projections.near_vectors(docs).collect()), key=repr)
    want = [r if r[0] is not None or r[2] is not None else (None, 0, None, True) for r in brute(rows)]
    assert found == sorted(want, key=repr)
    assert projections.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_dense_group_sends_one_link_a_vector(spark):
    rows = [(i, [1.0, i / 10000.0, 0.5], 1) for i in range(700)]
    classes = projections.classes_of(projections.labelled(spark.createDataFrame(rows, SCHEMA)))
    stars = projections.links(classes.checkpoint() if spark.sparkContext.getCheckpointDir() else classes, passes=3, window=50, block=100)
    assert stars.count() <= 3 * 2 * len(rows)
    assert {(r.n_links, r.component_id) for r in projections.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()} == {(699, 0)}
