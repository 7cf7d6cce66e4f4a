"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labels are read from the training fold only, and at most ``SAMPLE`` labelled documents are used, drawn by a hash of the id
and dealt to three parts: one teaches the lexicon (words and word beginnings that toxic documents use far more often than others),
one grows the trees, one calibrates their probability. The features of a document are densities of that lexicon and of a fixed list,
how near its hits are to words of the second person, capitals, punctuation, drawn-out letters and disguised words.
Whole texts are read. The score is the calibrated probability, to 1 % mixed with the plain one so that ties keep their order.

Nulls and edges: null and empty texts have features of zero; labels that are null or belong to no document teach nothing; several labels of
a document count as toxic if one is; without both classes in each part every score is 0; repeated rows give a row each; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnpress.llm.common import column, map_batches, remainder, stored

FOLDS, HELD_OUT = 5, 0
#: Labelled documents the model is fitted to, and the largest number of learned terms.
SAMPLE, TERMS = 20_000, 3_000
#: A term must occur in this share of the toxic documents, be so many times as frequent there as elsewhere, and its
#: log-likelihood ratio must be high enough not to be chance among many thousand terms.
LEAST_SHARE, LIFT, RATIO = 0.01, 8.0, 20.0
TREES, DEPTH, STEP = 20, 3, 0.3
BEGINNINGS = (4, 5, 6)

#: Insults, and words of the second person.
INSULTS = (
    "bastard clown coward creep dimwit disgusting dumb fool garbage idiot imbecile jerk liar loser lunatic moron pathetic "
    "psycho scum stupid trash ugly vermin worthless"
).split()
SECOND_PERSON = (
    "you your yours yourself yourselves ur tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros "
    "du dich dir dein deine deinen deiner euch euer"
).split()
DISGUISES = bytes.maketrans(b"013457@$!", b"oieastasi")
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS = bytes(range(65, 91))
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
#: Starts only at the first letter of a run and never gives letters back, so a run of any length is read once.
MIXED = re.compile(rb"(?<![a-z])[a-z]++[0-9@$!*]+[a-z][a-z0-9@$!*]*")
FEATURES = (
    "lexicon_density lexicon_hits lexicon_kinds lexicon_strongest lexicon_mean insult_density insult_hits nearness person_density capitals "
    "punctuation exclamations drawn_out disguised disguised_hits length"
).split()

INSULT_SET = frozenset(w.encode() for w in INSULTS)
PERSON_SET = frozenset(w.encode() for w in SECOND_PERSON)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(LETTERS).split()


def terms_of(words: list[bytes]) -> set[bytes]:
    """Words, and marked beginnings of longer words."""
    kinds = set(words)
    return kinds | {w[:k] + b"*" for w in kinds for k in BEGINNINGS if len(w) > k}


class Lexicon:
    """Learned terms with their strength; terms that end in a star are beginnings of words."""

    def __init__(self, terms: dict[bytes, float]):
        self.words = {t: s for t, s in terms.items() if not t.endswith(b"*")}
        self.starts = [{t[:-1]: s for t, s in terms.items() if t.endswith(b"*") and len(t) == k + 1} for k in BEGINNINGS]

    def hits(self, words: list[bytes]) -> tuple[list[int], list[float]]:
        """Places of words that are terms or begin with one, and the strength of the strongest."""
        known, (s4, s5, s6) = self.words, self.starts
        at = [i for i, w in enumerate(words) if w in known or w[:4] in s4 or w[:5] in s5 or w[:6] in s6]
        strength = [max(known.get(w, 0.0), s4.get(w[:4], 0.0), s5.get(w[:5], 0.0), s6.get(w[:6], 0.0)) for w in (words[i] for i in at)]
        return at, strength


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    words, raw = words_of(text), text.encode("utf-8", "replace")
    at, strength = lexicon.hits(words)
    rude = [i for i, w in enumerate(words) if w in INSULT_SET]
    persons = [i for i, w in enumerate(words) if w in PERSON_SET]
    hits, nearness = sorted({*at, *rude}), 0.0
    if hits and persons:
        place = np.searchsorted(persons, hits)
        known = np.array(persons)
        right = np.abs(known[np.minimum(place, len(known) - 1)] - hits)
        nearness = 1.0 / float(min(right.min(), np.abs(known[np.maximum(place - 1, 0)] - hits).min()) + 1)
    data = np.frombuffer(raw, np.uint8)
    drawn = int(((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] > 64)).sum())
    mixed = MIXED.findall(raw.lower()) if any(c in raw for c in b"0134579@$!*") else []
    plain = [m.translate(DISGUISES, b"*") for m in mixed]
    n, size = max(1, len(words)), max(1, len(raw))
    return [
        len(at) / n,
        float(np.log1p(len(at))),
        float(len({words[i][:4] for i in at})),
        max(strength, default=0.0),
        sum(strength) / max(1, len(strength)),
        len(rude) / n,
        float(np.log1p(len(rude))),
        nearness,
        len(persons) / n,
        (size - len(raw.translate(None, CAPITALS))) / size,
        (size - len(raw.translate(None, PUNCTUATION))) / size,
        (raw.count(b"!") + raw.count(b"?")) / size,
        drawn / size,
        len(mixed) / n,
        float(sum(p in lexicon.words or p in INSULT_SET for p in plain)),
        float(np.log1p(len(words))),
    ]


def learn_terms(labelled: DataFrame) -> dict[bytes, float]:
    """Terms of toxic documents and their strength, the logarithm of their log-likelihood ratio.

    A batch counts its own documents first, at most ``TERMS`` terms come back.
    """

    def run(batch: pa.RecordBatch) -> dict:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(terms_of(words_of(text or "")))
            counts[toxic][b""] += 1
        terms = list(counts[0].keys() | counts[1].keys())
        return {"term": terms, "clean": [counts[0][t] for t in terms], "toxic": [counts[1][t] for t in terms]}

    counted = map_batches(labelled.select("text", "toxic"), run, "term binary, clean long, toxic long", None)
    totals = stored(counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic >= 3"))
    everything = totals.where(F.length("term") == 0).first()
    if everything is None:
        return {}
    toxic, clean = everything["toxic"], everything["clean"]
    lift = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    share = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    ratio = 2 * (_surprise(F.col("toxic"), share * toxic) + _surprise(F.col("clean"), share * clean))
    frequent = (F.length("term") > 0) & (F.col("toxic") >= LEAST_SHARE * toxic)
    good = totals.where(frequent & (lift >= LIFT)).withColumn("ratio", ratio).where(F.col("ratio") >= RATIO)
    return {bytes(r["term"]): math.log1p(r["ratio"]) for r in good.orderBy(F.col("ratio").desc(), "term").limit(TERMS).collect()}


def _surprise(seen, expected):
    return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)


class Scorer:
    """Everything a score needs: the learned terms, the trees and the calibration; without trees all scores are 0."""

    def __init__(self, terms: dict[bytes, float], trees=None, calibration=None):
        self.terms, self.trees, self.calibration = terms, trees, calibration

    def featured(self, docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
        """``keep`` columns and ``features`` of column ``text`` (or a field ``struct.text`` of a kept one) for every row."""
        lexicon, kinds = Lexicon(self.terms), dict(docs.dtypes)
        columns = list(keep)

        def run(batch):
            rows = [features(t, lexicon) for t in column(batch, text).to_pylist()]
            return {c: batch.column(c) for c in columns} | {"values": rows}

        schema = "".join(f"`{c}` {kinds[c]}, " for c in columns) + "values array<double>"
        made = map_batches(docs.select(*dict.fromkeys([*columns, text.split(".")[0]])), run, schema)
        return made.withColumn("features", array_to_vector("values")).drop("values")

    def probability(self, featured: DataFrame) -> DataFrame:
        scored = self.trees.transform(featured).withColumn("raw", vector_to_array("probability")[1])
        return scored.drop("probability", "rawPrediction", "prediction", "features")

    def score(self, docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
        """``keep`` columns, ``score`` and ``predicted`` for every row of ``docs``."""
        if self.trees is None:
            return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
        raw = self.probability(self.featured(docs, *keep, text=text))
        calibrated = self.calibration.transform(raw)
        value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("prediction") + 0.01 * F.col("raw")))
        scored = calibrated.select(*keep, value.alias("score"))
        return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fit to the labelled documents of ``docs`` (``doc_id, text``) outside the held-out fold."""
    fold = remainder(F.col("doc_id"), FOLDS)
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marks.where(fold != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(20))
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("part", part))  # SAMPLE ids at most
    counts = {(r["third"], r["toxic"]): r["count"] for r in sample.groupBy(_third().alias("third"), "toxic").count().collect()}
    if any(not counts.get((t, c)) for t in range(3) for c in range(2)):
        return Scorer({})
    scorer = Scorer(learn_terms(sample.where(_third() == 0)))
    ready = stored(scorer.featured(sample.where(_third() > 0), "doc_id", "part", "toxic"))
    positive = counts[1, 1] / (counts[1, 0] + counts[1, 1])
    weight = F.when(F.col("toxic") == 1, 0.5 / positive).otherwise(0.5 / (1 - positive))
    grown = ready.where(_third() == 1).withColumn("weight", weight).coalesce(4)
    scorer.trees = GBTClassifier(
        labelCol="toxic", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=5, seed=1
    ).fit(grown)
    held = scorer.probability(ready.where(_third() == 2)).select(F.col("toxic").cast("double").alias("toxic"), "raw")
    scorer.calibration = IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(held.coalesce(4))
    return scorer


def _third():
    """0: lexicon, 1: trees, 2: calibration."""
    return F.when(F.col("part") < 9, 0).when(F.col("part") < 15, 1).otherwise(2)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    return train(docs, labels).score(packed, "row", text="row.text").where("predicted = 0").select("row.*")
