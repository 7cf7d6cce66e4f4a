import math

from dawnpress.operators import learning
from pyspark.sql import functions as F


def test_sessions_go_one_way(spark):
    rows = spark.range(4000).select((F.col("id") % 400).cast("string").alias("session_id")).withColumn("out", learning.held_out(F.col("session_id")))
    per = rows.groupBy("session_id").agg(F.countDistinct("out").alias("n"), F.first("out").alias("out")).collect()
    assert {r.n for r in per} == {1} and 40 < sum(r.out for r in per) < 120


def test_measures_equal_plain_sums(spark):
    heads = [*learning.FLAG_HEADS, "watch_time"]
    values = [(-1.5 + 0.01 * i, float(i % 3 == 0)) for i in range(300)]
    rows = spark.createDataFrame([(*[x for x, _ in [v] * 6], *[y for _, y in [v] * 6]) for v in values], [f"logit_{h}" for h in heads] + [f"target_{h}" for h in heads])
    found = {r["head"]: r for r in learning.head_measures(rows).collect()}
    p = [1 / (1 + math.exp(-x)) for x, _ in values]
    y = [t for _, t in values]
    log_loss = lambda ps: -sum(math.log(a if t else 1 - a) for a, t in zip(ps, y, strict=True)) / len(y)
    mean = sum(y) / len(y)
    bins = {}
    for a, t in zip(p, y, strict=True):
        bins.setdefault(int(a * 10), []).append(a - t)
    calibration = sum(abs(sum(b)) for b in bins.values()) / len(y)
    like, watch = found["like"], found["watch_time"]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in ((like.loss, log_loss(p)), (like.base_loss, log_loss([mean] * len(y))), (like.calibration, calibration)))
    assert math.isclose(watch.loss, sum((a - t) ** 2 for a, t in zip(p, y, strict=True)) / len(y), rel_tol=1e-9)
    assert math.isclose(watch.base_loss, mean - mean**2, rel_tol=1e-9) and like.rows == 300


def test_phase_crosstab_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        made.add(1)
        return [float(i % 3), float(i % 5)]

    users = spark.range(60).select(vector("id").alias("vec"), F.col("id").alias("step"), F.lit(59).alias("total"))
    table = learning.phase_crosstab(users, "step", "total").collect()
    assert sum(r.early + r.mid + r.late for r in table) == 60
    assert made.value == 60
