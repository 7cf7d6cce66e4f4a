import hashlib
import random

import numpy as np
from dawnpress.operators import spherical

SCHEMA = "item_id long, vec array<float>"


def drawn(seed, n=300, dim=12, groups=6):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((groups, dim))
    return [(i, [float(np.float32(x)) for x in base[i % groups] + 0.4 * draw.standard_normal(dim)]) for i in range(n)]


def brute(rows, k, iterations=18, seed=1337):
    rows = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if np.linalg.norm(v) > 0]
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{seed}|{r[0]}".encode()).hexdigest(), r[0]))
    centres, before = [v for _, v in order[:k]], {}
    for step in range(iterations):
        at = {i: max(range(len(centres)), key=lambda c: (round(float(v @ centres[c]), 9), -c)) for i, v in rows}
        if sum(before.get(i) != c for i, c in at.items()) <= max(1, int(0.01 * len(rows))):
            break
        before = at
        if step < iterations - 1:
            for c in range(len(centres)):
                total = sum((np.rint(v * 2**32) for i, v in rows if at[i] == c), np.zeros(len(rows[0][1])))
                centres[c] = total / np.linalg.norm(total) if np.linalg.norm(total) else centres[c]
    return at


def test_equals_plain_loop(spark):
    rows = drawn(1)
    found = spherical.spherical_kmeans(spark.createDataFrame(rows, SCHEMA), 9)
    assert {r.item_id: r.cluster_id for r in found.collect()} == brute(rows, 9)


def test_partitions_do_not_matter(spark):
    rows = drawn(2)
    random.Random(3).shuffle(rows)
    frames = [spark.createDataFrame(rows, SCHEMA).repartition(n) for n in (1, 7)]
    first, second = (spherical.fit(spherical.usable(f), 8) for f in frames)
    assert first[1] == second[1] and 1 < first[1] < 18 and (first[0] == second[0]).all()


def test_edges(spark):
    assert spherical.spherical_kmeans(spark.createDataFrame([], SCHEMA), 3).collect() == []
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 3.0])]
    found = {r.item_id: r.cluster_id for r in spherical.spherical_kmeans(spark.createDataFrame(rows, SCHEMA), 10).collect()}
    assert set(found) == {2, 3, 4} and found[3] == found[4] != found[2]
