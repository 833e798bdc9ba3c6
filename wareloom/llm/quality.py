"""Quality scores by naive-Bayes support vectors.

Features are hashed n-gram indicators (see ``ngrams``), scaled by the log-count ratio of the two classes; a linear
hinge-loss model over the scaled, length-normalised sets is fitted by dual coordinate descent; its margin becomes
a score in [0, 1] by a logistic curve fitted on rows that the hinge model has not seen.

Dual coordinate descent visits one row at a time, so the model is fitted in one task, on a bounded sample of the labelled
rows: the ``MAX_TRAIN`` with the least hash of doc_id. The bound is a parameter; as the sample is bounded, its ids are
broadcast and no text is shuffled. Nothing else is sampled: every row of the table is scored over its whole text.

Edge cases: a null or empty text has no features and gets the intercept's score; a label that is null or neither 0
nor 1 trains nothing; of repeated rows with one id and label one teaches; without training rows of both classes every score is 0.5;
an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import col, ship, trim, written

MAX_TRAIN = 12_000
PASSES = 12
COST = 1.0
THRESHOLD = 0.3


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled(labels: DataFrame, label: str, limit: int, salt: int = 17) -> DataFrame:
    """doc_id, y, fold of limit labelled rows at most that may be learned from, the same however the table is partitioned."""
    rows = labels.select(col("doc_id").alias("doc_id"), col(label).cast("int").alias("y")).where("y IN (0, 1)")
    rows = rows.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    return rows.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id", "y").limit(limit)


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample's rows with their texts; the sample is bounded, so it is broadcast."""
    d = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    return d.join(F.broadcast(sample), "doc_id")


def log_ratio(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log of the classes' smoothed feature shares; 0 for features that no training row has."""
    n = np.zeros((2, ngrams.DIMENSIONS))
    for s, own in zip(sets, y):
        n[int(own)][s] += 1  # a set's features are distinct
    share = np.log(n + 1) - np.log((n + 1).sum(axis=1, keepdims=True))
    return np.where(n.any(axis=0), share[1] - share[0], 0.0)


def dual_coordinate_descent(sets: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights times ratios and intercept of the L1-loss support vector machine; classes weigh the same in total."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, y.mean(), 1 - y.mean())
    bound = COST * 0.5 / np.maximum(share, 1e-9)
    # Scaled rows are not kept beside the sets: w stands for the weights times the ratios.
    square = ratio * ratio
    unit = np.array([1 / np.sqrt(max(len(s), 1)) for s in sets])
    norm = np.array([square[s].sum() for s in sets]) * unit * unit + 1.0
    w, b, alpha, rng = np.zeros(len(ratio)), 0.0, np.zeros(len(sets)), np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in rng.permutation(len(sets)):
            gradient = sign[i] * (w[sets[i]].sum() * unit[i] + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), bound[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[sets[i]] += step * unit[i] * square[sets[i]]
                b += step
                alpha[i] = new
    return w, b


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin * margin).sum(), (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAIN) -> dict | None:
    """Weights (already scaled by the ratios), intercept and curve; None without rows of both classes."""
    ship(docs.sparkSession)
    sample = sample_texts(docs, labelled(labels, label, limit)).withColumn("curve", F.col("fold") == 1)

    def features(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "curve": f["curve"],
                                "features": [s.astype(np.int32).tobytes() for s in ngrams.sets(f["text"])]})

    def learn(frames):
        rows, sets = ngrams.flat(frames, {"features": np.int32}, ["doc_id", "y"])
        if not len(rows):
            return
        sets = [s for s, in sets]
        y, curve = rows["y"].to_numpy(), rows["curve"].to_numpy()
        own = np.flatnonzero(~curve)
        if len(set(y[own])) < 2:
            return
        ratio = log_ratio([sets[i] for i in own], y[own])
        scaled, b = dual_coordinate_descent([sets[i] for i in own], y[own], ratio)
        held = np.flatnonzero(curve) if len(set(y[curve])) == 2 else own
        margin = np.array([scaled[sets[i]].sum() / np.sqrt(max(len(sets[i]), 1)) for i in held]) + b
        slope, offset = logistic_curve(margin, y[held])
        del rows, sets
        trim()
        yield pd.DataFrame({"model": [json.dumps([b, slope, offset])], "weights": [scaled.astype(np.float32).tobytes()]})

    # Repeated documents of one id teach once, so that the task below reads limit rows at most.
    sets = written(sample.mapInPandas(features, "doc_id long, y int, curve boolean, features binary").groupBy(
        "doc_id", "y", "curve").agg(F.min("features").alias("features")), "quality-sample")
    found = sets.coalesce(1).mapInPandas(learn, "model string, weights binary").collect()
    if not found:
        return None
    b, slope, offset = json.loads(found[0]["model"])
    return {"weights": np.frombuffer(bytes(found[0]["weights"]), np.float32), "intercept": b, "slope": slope, "offset": offset}


def scorer(model: dict | None):
    """A pandas UDF from text to score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if model is None:
                yield pd.Series(np.full(len(texts), 0.5))
                continue
            margin = ngrams.margins(texts, model["weights"][None, :])[:, 0] + model["intercept"]
            yield pd.Series(1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -30, 30))))
        trim()

    return score


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels, limit=limit)
    scored = docs.select(col("doc_id").alias("doc_id"), scorer(model)(col("text")).alias("score"))
    return scored.select(
        "doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(-1)) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of threshold or more, all columns as they were."""
    model = fit(docs, labels, limit=limit)
    return docs.where(scorer(model)(col("text")) >= threshold)
