"""The balanced frame helpers equal plain windows, also across bucket borders."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from dawnpress.operators import frames


def rows(spark, n=400, seed=1):
    rng = random.Random(seed)
    data = [(rng.choice("aaaaab"), i, rng.randint(0, 9), rng.random() < 0.3) for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, t int, v int, flag boolean")


def test_sequence_number(spark):
    df = frames.sequence_number(rows(spark), ["k"], ["t"], F.floor(F.col("t") / 7), "n")
    plain = df.withColumn("m", F.row_number().over(Window.partitionBy("k").orderBy("t")))
    assert plain.where("n <> m").count() == 0 and plain.count() == 400


def test_rolling_with_small_buckets(spark):
    df = frames.sequence_number(rows(spark), ["k"], ["t"], F.floor(F.col("t") / 7), "n")
    got = frames.rolling(df, ["k"], "n", 5, {"s": lambda w: F.sum("v").over(w.rowsBetween(-5, -1))}, bucket=6)
    want = got.withColumn("z", F.sum("v").over(Window.partitionBy("k").orderBy("n").rowsBetween(-5, -1)))
    assert want.where("not (s <=> z)").count() == 0 and want.count() == 400


def test_running_sum_and_max(spark):
    df = frames.sequence_number(rows(spark), ["k"], ["t"], F.floor(F.col("t") / 7), "n")
    got = frames.running(df, ["k"], "n", {"s": F.col("v")}, bucket=9)
    got = frames.running_max(got, ["k"], "n", "m", F.when(F.col("flag"), F.col("n")), bucket=9)
    w = Window.partitionBy("k").orderBy("n")
    want = got.withColumn("s2", F.sum("v").over(w)).withColumn("m2", F.max(F.when(F.col("flag"), F.col("n"))).over(w))
    assert want.where("not (s <=> s2) or not (m <=> m2)").count() == 0 and want.count() == 400


def test_global_position(spark):
    df = frames.global_position(rows(spark), ["v", "t"], F.col("v"), "p")
    got = [r.t for r in df.orderBy("p").collect()]
    assert got == [r.t for r in rows(spark).orderBy("v", "t").collect()]
    assert sorted(r.p for r in df.collect()) == list(range(400))
