import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dawnpress.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_mix(rows, weights=(1, 2, 3), cap=3):
    """(doc_id, size, source_size, target, taken) by plain loops over sorted lists."""
    sized = [(d, s, len(WORD.findall(t or ""))) for d, t, s in rows]
    words = defaultdict(int)
    for _, s, n in sized:
        words[s] += n
    sources = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, left, open_sources = {}, float(sum(words.values())), set(sources)
    while open_sources:
        factor = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if cap * words[s] <= weight[s] * factor}
        if not full:
            target.update({s: weight[s] * factor for s in open_sources})
            break
        target.update({s: float(cap * words[s]) for s in full})
        left -= sum(cap * words[s] for s in full)
        open_sources -= full
    out = []
    for s in sources:
        own = [(d, n) for d, x, n in sized if x == s]
        value = lambda n: (n + 1).bit_length() + 4.0
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(cap, mid * value(n)) * n for _, n in own) < target[s] else (low, mid)
        copies, draws, sure = {}, [], 0
        for i, (d, n) in enumerate(own):
            expected = min(cap, high * value(n)) if target[s] else 0.0
            copies[i] = int(expected + 1e-9)
            p = expected - copies[i]
            sure += copies[i] * n
            if p > 1e-9:
                digest = hashlib.md5(f"{'null' if d is None else d}:mix".encode()).hexdigest()
                u = (int(digest[:12], 16) + 0.5) / 2**48
                draws.append((u / (1 - u) / (p / (1 - p)), -1 if d is None else d, i, n))
        need, got, taken = target[s] - sure, 0, set()
        draws.sort()
        for q in sorted({x[:2] for x in draws}):
            same = [x for x in draws if x[:2] == q]
            if got + sum(x[3] for x in same) > need + 1e-6:
                break
            got += sum(x[3] for x in same)
            taken |= {x[2] for x in same}
        gap = need - got
        rest = [(abs(n - gap), d, i) for _, d, i, n in draws if i not in taken and abs(n - gap) < gap - 1e-6]
        if rest:
            taken |= {i for _, d, i, n in draws if d == min(rest)[1] and i not in taken and n == own[min(rest)[2]][1]}
        out += [(d, n, words[s], round(target[s], 4), (copies[i] + (i in taken)) * n) for i, (d, n) in enumerate(own)]
    return out


def rows_of(frame):
    return [(r.doc_id, r.size, r.source_size, round(r.target, 4), r.taken) for r in frame.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 7)
    rows = [(i, "w " * (3 + i * 37 % 90), f"s{i % 5 if i % 3 else 0}") for i in range(160)]
    rows += [(900 + i, "only few words", None) for i in range(4)] + [(1000, "", "empty"), (1001, None, "empty"), (1002, "one", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    found = rows_of(mixing.mix(docs.repartition(3)))
    assert ordered(found) == ordered(brute_mix(rows))
    assert ordered(rows_of(mixing.mix(docs.repartition(6)))) == ordered(found)


def test_shares(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.mix(docs)
    per_source = found.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    assert all(abs(r.taken - r.target) <= 0.06 * r.target for r in per_source.collect())
    assert found.where("taken > 3 * size").count() == 0


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None), (None, None, None)], schema)
    assert {(r.size, r.target, r.taken) for r in mixing.mix(nothing).collect()} == {(0, 0.0, 0)}
    twice = spark.createDataFrame([(1, "a b c", "s")] * 2 + [(None, "d e", "s")] * 2 + [(3, "f " * 50, "t")], schema)
    found = rows_of(mixing.mix(twice))
    assert len(found) == 5 and found == [*found] and len({r for r in found if r[0] == 1}) == 1


def test_repeated_rows(spark):
    rows = [(i, f"text {i} " * 5, f"s{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_level", F.lit(None).cast("string")).drop("_level")
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in copies.items() if v}


def test_no_python(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


@pytest.mark.parametrize("size", [0, 1, 3, 4, 1000])
def test_levels(spark, size):
    row = spark.range(1).select(mixing.level_of(F.lit(size)).alias("level")).first()
    assert row.level == (size + 1).bit_length()
