"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model (see ``linear``) reads the text's features and the
probabilities of the categories before it. In training those probabilities are out-of-fold: a row's come from a model
that has not seen the row, as it will be for new texts. The chain here is ``CHAIN``: first poor quality, then toxicity,
the categories of the labels table.

The models are fitted in one task on a bounded sample of labelled rows (``MAX_TRAIN``, a parameter, those with the least
hash of doc_id, none of the held-out fold). Every row of the table is scored over its whole text.

Edge cases: a null or empty text has no words and gets the intercepts' scores; labels that are null or neither 0 nor 1
teach nothing; of repeated rows with one id one teaches; without rows of both classes a category's probability is its
share, 0 without labels; an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear, ngrams
from .common import col, ship, trim, written
from .quality import fold

#: (category, column of labels, value that means the category)
CHAIN = (("poor", "quality", 0), ("toxic", "toxic", 1))
MAX_TRAIN = 8_000
THRESHOLD = 0.5


def labelled(labels: DataFrame, chain, limit: int, salt: int = 29) -> DataFrame:
    """doc_id and a 0/1 column y<i> a category, of limit rows at most; the same however the table is partitioned."""
    rows = labels.select(
        col("doc_id").alias("doc_id"),
        *[F.when(col(c).isin(0, 1), (col(c) == v).cast("int")).alias(f"y{i}") for i, (_, c, v) in enumerate(chain)])
    names = [f"y{i}" for i in range(len(chain))]
    rows = rows.where(" AND ".join(f"{n} IS NOT NULL" for n in names)).where(fold(F.col("doc_id")) != 0)
    return rows.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id", *names).limit(limit)


def fit_chain(rows, ys: np.ndarray, folds: np.ndarray) -> list[linear.Model]:
    extra, models = np.zeros((len(rows), 0)), []
    for y in ys.T:
        if len(set(y)) < 2:
            share = float(y.mean()) if len(y) else 0.0
            logit = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
            models.append(linear.Model(np.zeros(linear.SIZE, np.float32), np.zeros(extra.shape[1]), logit))
            extra = np.column_stack([extra, np.full(len(rows), share)])
            continue
        model, p = linear.out_of_fold(rows, extra, y, folds)
        models.append(model)
        extra = np.column_stack([extra, p])
    return models


def training_features(docs: DataFrame, sample: DataFrame, labels: list[str]) -> DataFrame:
    """doc_id, labels, feature, value of the sample's texts; the sample is bounded, so it is broadcast."""
    names = ", ".join(f"{n} int" for n in labels)

    def features(frames):
        for f in frames:
            found = linear.densities(f["text"])
            out = f[["doc_id", *labels]].copy()
            out["feature"], out["value"] = [x.tobytes() for x, _ in found], [v.tobytes() for _, v in found]
            yield out

    d = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text")).join(F.broadcast(sample), "doc_id")
    made = d.select("doc_id", *labels, "text").mapInPandas(features, f"doc_id long, {names}, feature binary, value binary")
    # Repeated documents of one id teach once.
    return written(made.groupBy("doc_id", *labels).agg(F.min(F.struct("feature", "value")).alias("x")).select(
        "doc_id", *labels, "x.feature", "x.value"), "sample")


def training_rows(frames, labels: list[str]):
    """(rows, labels, folds) in an order of their own."""
    f, rows = ngrams.flat(frames, {"feature": np.int32, "value": np.float32}, ["doc_id", *labels])
    if not rows:
        return [], np.zeros((0, len(labels)), int), np.zeros(0, np.uint64)
    folds = pd.util.hash_array(f["doc_id"].to_numpy().astype(np.int64)) % np.uint64(linear.FOLDS)
    return rows, f[labels].to_numpy(), folds


def fit(docs: DataFrame, labels: DataFrame, chain=CHAIN, limit: int = MAX_TRAIN) -> list[linear.Model]:
    ship(docs.sparkSession)
    names = [f"y{i}" for i in range(len(chain))]
    data = training_features(docs, labelled(labels, chain, limit), names)

    def learn(frames):
        data = training_rows(frames, names)
        if len(data[0]):
            models = pickle.dumps(fit_chain(*data))
            del data
            trim()
            yield pd.DataFrame({"models": [models]})

    found = data.coalesce(1).mapInPandas(learn, "models binary").collect()
    if found:
        return pickle.loads(bytes(found[0]["models"]))
    return fit_chain([], np.zeros((0, len(chain))), np.zeros(0))


def probabilities(models: list[linear.Model], texts: pd.Series) -> np.ndarray:
    """texts x categories, along the chain."""
    base, _ = linear.margins(texts, np.stack([m.weights for m in models]))
    p = np.zeros((len(texts), 0))
    for i, m in enumerate(models):
        p = np.column_stack([p, m.probability(base[:, i] + p @ m.more + m.intercept)])
    return p


def score(docs: DataFrame, labels: DataFrame, chain=CHAIN, limit: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, p_<category> for each category, and toxic (0/1, by the last category) of every row."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, chain, limit))  # fixed size
    names = [f"p_{c}" for c, _, _ in chain]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(probabilities(models.value, texts), columns=names)
        trim()

    scored = docs.select(col("doc_id").alias("doc_id"), predict(col("text")).alias("p")).select("doc_id", "p.*")
    return scored.select(
        "doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(-1)) == 0).alias("held_out"), *names,
        F.when(F.col(names[-1]) >= threshold, 1).otherwise(0).cast("int").alias(chain[-1][0]))
