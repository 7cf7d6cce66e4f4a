"""Language identification by nearest centroids.

A text is the vector of its letter n-grams (one to three bytes of lower-case UTF-8, everything but letters as one space),
hashed to ``DIMENSIONS`` places, weighted by TF-IDF and scaled to length one. Document frequencies are
counted over all training documents. Each language has several centroids, found by spherical k-means over a sample of at most
``SAMPLE`` training documents of it. A text gets the language of the centroid with the largest cosine; it is marked as rejected if
it is further from that centroid than all but a small share of the language's own sample. Every language is learned; centroids are kept
in a table and come to the driver and the workers in blocks of ``LANGUAGES`` languages, the best of all blocks counts.

Nulls and edges: texts without a letter, null and empty ones are ``und`` with score 0; documents without a language
teach nothing; with nothing to learn from, every text is ``und``; repeated rows each get a row; ids may be null; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnpress.llm.common import map_batches, remainder, stored

DIMENSIONS = 4096
#: Training documents of a language that its centroids are fitted to; document frequencies use all.
SAMPLE = 1000
#: Languages whose centroids are held at once; texts are scored against one such block after another.
LANGUAGES = 200
DRAWS = 1 << 40
CENTROIDS = 3
ROUNDS = 12
#: Share of a language's sample that lies beyond its rejection distance.
OUTLIERS = 0.005
FOLDS, HELD_OUT = 3, 1
ROWS = 128
NO_LETTER = "und"

ASCII_LETTER = re.compile(r"[A-Za-z]")
TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def grams(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of the hashed n-grams of one text."""
    plain = b" ".join(text.lower().encode("utf-8", "replace").translate(TABLE).split())
    data = np.frombuffer(b" " + plain + b" ", np.uint8).astype(np.uint32)
    pairs = data[:-1] << 8 | data[1:]
    triples = pairs[:-1] << 8 | data[2:]
    codes = np.concatenate([data, pairs + np.uint32(1 << 24), triples + np.uint32(1 << 25)])
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(32 - dimensions.bit_length() + 1), minlength=dimensions)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length one, one row per text."""
    counts = np.array([grams(t, len(idf)) for t in texts], np.float32)
    weighted = np.log1p(counts) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` unit centroids; starts from points far from each other, so it repeats itself."""
    mean = points.mean(axis=0)
    centres = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(centres) < min(k, len(points)):
        centres.append(points[(points @ np.array(centres).T).max(axis=1).argmin()])
    centroids = np.array(centres)
    for _ in range(rounds):
        nearest = (points @ centroids.T).argmax(axis=1)
        sums = np.array([points[nearest == j].sum(axis=0) if (nearest == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training documents each place occurs, and their number; every task adds up its own first."""

    def run(batch):
        seen = np.zeros(DIMENSIONS, np.int64)
        texts = [t for t in batch.column("text").to_pylist() if t and has_letter(t)]
        for text in texts:
            seen += grams(text) > 0
        return {"place": np.arange(-1, DIMENSIONS), "n": np.r_[len(texts), seen]}

    counts = map_batches(training.select("text"), run, "place int, n long", None).groupBy("place").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(DIMENSIONS + 1)
    for row in counts:  # one row per place
        found[row["place"]] = row["n"]
    return found[:-1], int(found[-1])


class Model:
    """Centroids with their languages and rejection cosines."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], limits: dict[str, float]):
        self.idf, self.centroids, self.languages, self.limits = idf, centroids.astype(np.float32), languages, limits

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [NO_LETTER] * len(texts), [0.0] * len(texts), [True] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for a in range(0, len(rows), ROWS):
            some = rows[a : a + ROWS]
            cosines = vectors([texts[i] for i in some], self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            for i, j, value in zip(some, best.tolist(), cosines[np.arange(len(some)), best].tolist(), strict=True):
                langs[i], scores[i] = self.languages[j], value
                rejected[i] = value < self.limits[self.languages[j]]
        return langs, scores, rejected


def train(docs: DataFrame) -> list[Callable[[], Model]]:
    """Fit to all rows of ``docs`` (``doc_id, text, lang``) that have a language; each call gives the model of a block of languages."""
    known = docs.where("lang IS NOT NULL").select("doc_id", "text", "lang")
    seen, n = document_frequencies(known)
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    # texts are drawn by the hash of id and text, so neither null nor repeated ids matter, and equal rows are one draw
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(DRAWS)).alias("draw")
    sizes = stored(known.groupBy("lang").count())
    # draws below four times the sample's share: no task ranks more than some thousand rows of a language of any size
    low = known.select("text", "lang", draw).join(sizes, "lang").where(F.col("draw") < F.lit(4.0 * SAMPLE * DRAWS) / F.col("count"))
    by_draw = Window.partitionBy("lang").orderBy("draw", "text")
    sample = low.select("lang", "text", "draw").distinct().withColumn("nth", F.row_number().over(by_draw)).where(F.col("nth") <= SAMPLE)

    def points_of(batch):
        texts = [(lang, t) for lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t and has_letter(t)]
        return {"lang": [lang for lang, _ in texts], "point": list(vectors([t for _, t in texts], idf)) if texts else []}

    drawn = map_batches(sample.select("lang", "text"), points_of, "lang string, point array<float>", rows=ROWS)

    def fit(key, frame):
        import pandas as pd

        points = np.stack(frame["point"].to_list())
        centroids = spherical_kmeans(points, CENTROIDS)
        limit = float(np.quantile((points @ centroids.T).max(axis=1), OUTLIERS))
        return pd.DataFrame({"lang": key[0], "centroid": [c.tobytes() for c in centroids.astype(np.float32)], "cosine": limit})

    fitted = stored(drawn.groupBy("lang").applyInPandas(fit, "lang string, centroid binary, cosine double"))
    names = sorted(r["lang"] for r in fitted.select("lang").distinct().collect())

    def block(first: str, last: str) -> Model:
        rows = fitted.where(F.col("lang").between(first, last)).orderBy("lang", "centroid").collect()  # at most LANGUAGES * CENTROIDS rows
        centroids = np.array([np.frombuffer(r["centroid"], np.float32) for r in rows]).reshape(-1, DIMENSIONS)
        return Model(idf, centroids, [r["lang"] for r in rows], {r["lang"]: r["cosine"] for r in rows})

    blocks = [names[a : a + LANGUAGES] for a in range(0, len(names), LANGUAGES)]
    return [partial(block, some[0], some[-1]) for some in blocks] or [lambda: Model(idf, np.zeros((0, DIMENSIONS)), [], {})]


def identify(docs: DataFrame, models: list[Callable[[], Model]]) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row of ``docs``."""
    rows, names = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ("lang_pred", "score", "rejected")
    for k, make in enumerate(models):
        last = k + 1 == len(models)
        rows = best_of(rows, docs.sparkSession.sparkContext.broadcast(make()), names, first=k == 0, last=last)
        rows = rows if last else stored(rows)  # ends the reach of the block's centroids
    return rows.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")))


def best_of(rows: DataFrame, shared, names: tuple[str, ...], first: bool, last: bool) -> DataFrame:
    """``rows`` (``doc_id, text``, after the first block also the best so far) with the better of that and this block."""

    def run(batch):
        found = shared.value.predict(batch.column("text").to_pylist())
        if not first:
            before = [batch.column(n).to_pylist() for n in names]
            better = [new > old for new, old in zip(found[1], before[1], strict=True)]
            found = [[n if b else o for n, o, b in zip(new, old, better, strict=True)] for new, old in zip(found, before, strict=True)]
        kept = {} if last else {"text": batch.column("text")}
        return {"doc_id": batch.column("doc_id")} | kept | dict(zip(names, found, strict=True))

    return map_batches(rows, run, f"doc_id long, {'' if last else 'text string, '}lang_pred string, score double, rejected boolean")


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Train on the documents outside the held-out fold and predict all."""
    fold = remainder(F.col("doc_id"), FOLDS)
    models = train(docs.where(fold != HELD_OUT))
    return identify(docs, models).withColumn("held_out", fold == HELD_OUT)
