"""Training tables and the six-head model on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnpress.functions import numeric as N
from dawnpress.functions import wordlists as W
from dawnpress.operators.windows import event_sequences
from dawnpress.session import cut_lineage

FLAG_HEADS = ["finish", "like", "share", "rewatch", "fast_skip"]


def training_rows(log: DataFrame, token: str = "token") -> DataFrame:
    """One row per interaction: token sequence before it, item ids, six targets, normalised reward."""
    before = event_sequences(log, token, after=False)
    targets = N.watch_targets(F.col("interest"))
    return before.withColumns({f"target_{n}": c for n, c in targets.items()}).withColumn("reward_norm", N.reward_norm(F.col("reward")))


def fit_heads(rows: DataFrame, ids: Sequence[str], numbers: Sequence[str], buckets: int = 1 << 12) -> dict[str, PipelineModel]:
    """Five logistic heads and one linear head on hashed ids and numeric columns."""
    hasher = FeatureHasher(inputCols=[*ids], outputCol="hashed", numFeatures=buckets, categoricalCols=[*ids])
    assembler = VectorAssembler(inputCols=["hashed", *numbers], outputCol="features")
    prepared = Pipeline(stages=[hasher, assembler]).fit(rows)
    labels = [f"target_{head}" for head in [*FLAG_HEADS, "watch_time"]]
    data = cut_lineage(prepared.transform(rows).select(*labels, "features"))  # six fits read it many times
    models = {"prepare": prepared}
    for head in FLAG_HEADS:
        models[head] = LogisticRegression(labelCol=f"target_{head}", maxIter=10, regParam=0.01, predictionCol=f"_p_{head}", rawPredictionCol=f"raw_{head}", probabilityCol=f"_q_{head}").fit(data)
    models["watch_time"] = LinearRegression(labelCol="target_watch_time", maxIter=10, regParam=0.01, predictionCol="raw_watch").fit(data)
    return models


def score_heads(rows: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Head logits and the combined ranking score."""
    out = models["prepare"].transform(rows)
    for head in FLAG_HEADS:
        out = models[head].transform(out).withColumn(f"logit_{head}", vector_to_array(f"raw_{head}")[1]).drop(f"raw_{head}", f"_p_{head}", f"_q_{head}")
    ratio = N.clamp(F.col("raw_watch"), 0.01, 0.99)
    out = models["watch_time"].transform(out).withColumn("logit_watch_time", F.log(ratio / (F.lit(1.0) - ratio))).drop("raw_watch")
    logits = {h: F.col(f"logit_{h}") for h in [*FLAG_HEADS, "watch_time"]}
    return out.drop("hashed", "features").withColumn("pred_score", N.head_score(logits, W.SERVING_WEIGHTS))


def held_out(session: Column, folds: int = 5) -> Column:
    """Whether a session is kept from training: by the hash of its id, so all its rows go the same way."""
    return F.crc32(F.coalesce(session.cast("string"), F.lit("")).cast("binary")) % folds == 0


def head_measures(scored: DataFrame, bins: int = 10) -> DataFrame:
    """``head, rows, loss, base_loss, calibration`` of scored rows with their targets.

    The loss of a flag head is its mean log loss, of the watch time its mean squared error; ``base_loss`` is what always predicting the
    rows' own mean would lose. Calibration is the mean distance of predicted and seen means over ``bins`` equal ranges of
    the prediction, weighted by their rows.
    """
    kinds = [F.struct(F.lit(h).alias("head"), N.sigmoid(F.col(f"logit_{h}")).alias("p"), F.col(f"target_{h}").cast("double").alias("y")) for h in [*FLAG_HEADS, "watch_time"]]
    long = scored.select(F.explode(F.array(*kinds)).alias("r")).select("r.*").where("p IS NOT NULL AND y IS NOT NULL")
    p, flag = N.clamp(F.col("p"), 1e-12, 1 - 1e-12), F.col("head") != "watch_time"
    loss = F.when(flag, -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).otherwise((F.col("y") - F.col("p")) ** 2)
    binned = long.withColumn("loss", loss).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    parts = binned.groupBy("head", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"), F.sum("p").alias("p"), F.sum("y").alias("y"), F.sum(F.col("y") ** 2).alias("yy")
    )
    whole = parts.groupBy("head").agg(
        F.sum("n").alias("rows"),
        (F.sum("loss") / F.sum("n")).alias("loss"),
        (F.sum("y") / F.sum("n")).alias("mean"),
        (F.sum("yy") / F.sum("n")).alias("square"),
        (F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("calibration"),
    )
    mean = N.clamp(F.col("mean"), 1e-12, 1 - 1e-12)
    base = F.when(flag, -(F.col("mean") * F.log(mean) + (1 - F.col("mean")) * F.log(1 - mean))).otherwise(F.col("square") - F.col("mean") ** 2)
    return whole.select("head", "rows", "loss", base.alias("base_loss"), "calibration")


def phase_crosstab(users: DataFrame, step: str, total: str, clusters: int = 3, seed: int = 42) -> DataFrame:
    """Rows per (k-means cluster of the user vector, early/mid/late third of the run)."""
    from pyspark.ml.clustering import KMeans

    third = F.when(F.col(step) <= F.floor(F.col(total) / 3), "early").when(F.col(step) <= F.floor(F.col(total) * 2 / 3), "mid").otherwise("late")
    rows = users.withColumn("phase", third).withColumn("features", array_to_vector("vec"))
    rows = cut_lineage(rows.select("phase", "features"))  # the fit passes over them many times
    assigned = KMeans(k=clusters, seed=seed).fit(rows).transform(rows)
    return assigned.groupBy(F.col("prediction").alias("cluster")).pivot("phase", ["early", "mid", "late"]).count().fillna(0)
