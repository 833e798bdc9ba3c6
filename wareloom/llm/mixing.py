"""Mixing to target weights with soft domain membership.

A classifier learned from a labelled table predicts each document's posterior over domains; by default the labels
table gives three: toxic, poor and good text. A document of n tokens with posterior p and rate r adds r * n * p[k] expected tokens to
domain k. Rates are the nonnegative ones that minimise the squared errors of the domains' totals against target weight * budget * all
tokens, each relative to the domain's present total, plus ``STAY`` times the squared changes of the rates from 1, weighted by tokens. So
the targets are met wherever nonnegative rates can, with the least change.

Gradients of the totals' errors are the same K numbers for every document, times its posterior. So the gradient steps add up
to one vector y, and the rate they lead to, projected onto what is allowed, is max(0, 1 - p . y). Each step sums totals, loss and the Gram
matrix of the rates that are free to move over all documents in Spark (ten numbers come back for three domains) and moves y against the
errors in the metric of that matrix, which makes a step exact while no rate meets its bound; a step that does not lessen the loss enough
is halved. Nothing but the posteriors is kept. The totals reached come back beside the rate; shares missed by more than ``MISSED`` are also logged.

``copies`` realises a rate: its whole part, and one more with the probability of the rest, by a hash of doc_id.

The classifier is fitted on a bounded sample of labelled rows (``MAX_TRAIN``); posteriors, totals and rates cover every row.

Edge cases: tokens are words; a null or empty text has none, gets the intercepts' posterior and still a rate; without labels the
posterior is uniform; a domain without expected tokens is left out of the fit; targets that
no nonnegative rates reach are met as closely as the loss says, and the shares reached tell so; a null doc_id is hashed like a value; repeated rows get equal rates; an empty table gives no rows.
"""

from __future__ import annotations

import logging
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear, toxicity
from .common import col, ship, trim, wrapped, written

DOMAINS = ("good", "poor", "toxic")
MAX_TRAIN = 6_000
STEPS = 60
#: Weight of staying near rate 1 against meeting the targets.
STAY = 1e-5
#: A share off its target by more than this is reported.
MISSED = 0.005
LOG = logging.getLogger(__name__)
#: A fit ends when no total is off its place by a larger share of all tokens, or the loss falls by a smaller share.
TOLERANCE = 1e-9


@dataclass
class Rates:
    """rate: SQL text of the rate of a row with p; shares: of the domains' expected tokens at these rates; total: all of them."""

    rate: str
    shares: list[float]
    total: float
    missed: bool


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain: a row of the labels table as an index into DOMAINS."""
    return labels.select(col("doc_id").alias("doc_id"), F.when(col("toxic") == 1, 2).when(col("quality") == 0, 1).when(
        col("quality") == 1, 0).cast("int").alias("domain"))


def fit_posteriors(docs: DataFrame, domains: DataFrame, k: int, limit: int = MAX_TRAIN) -> list[linear.Model] | None:
    """A one-against-rest model a domain, from limit labelled rows at most."""
    ship(docs.sparkSession)
    sample = domains.where(F.col("domain").between(0, k - 1) & F.col("doc_id").isNotNull()).orderBy(
        F.xxhash64("doc_id", F.lit(31)), "doc_id", "domain").limit(limit)
    data = toxicity.training_features(docs, sample, ["domain"])

    def learn(frames):
        rows, y, folds = toxicity.training_rows(frames, ["domain"])
        if not len(rows):
            return
        own = np.stack([(y[:, 0] == c).astype(int) for c in range(k)], axis=1)
        models = pickle.dumps([toxicity.fit_chain(rows, own[:, [c]], folds)[0] for c in range(k)])
        del rows
        trim()
        yield pd.DataFrame({"models": [models]})

    found = data.coalesce(1).mapInPandas(learn, "models binary").collect()
    return pickle.loads(bytes(found[0]["models"])) if found else None


def posteriors(docs: DataFrame, models: list[linear.Model] | None, k: int) -> DataFrame:
    """doc_id, n_tokens, p (array of k) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # fixed size

    @F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        weights = np.stack([m.weights for m in own]) if own else np.zeros((k, linear.SIZE), np.float32)
        for texts in batches:
            base, n = linear.margins(texts, weights)
            if own:
                p = np.stack([m.probability(base[:, i] + m.intercept) for i, m in enumerate(own)], axis=1) + 1e-9
                p /= p.sum(axis=1, keepdims=True)
            else:
                p = np.full((len(texts), k), 1 / k)
            yield pd.DataFrame({"n": n, "p": list(p)})
        trim()

    found = docs.select(col("doc_id").alias("doc_id"), predict(col("text")).alias("x"))
    return found.select("doc_id", F.col("x.n").alias("n_tokens"), F.col("x.p").alias("p"))


def rate_expression(y, low: float = 0.0, high: float | None = None) -> str:
    """SQL text of a row's rate, 1 - p . y within the bounds."""
    rate = f"greatest({low!r}D, 1D - ({' + '.join(f'p[{i}] * {float(v)!r}D' for i, v in enumerate(y))}))"
    return rate if high is None else f"least({high!r}D, {rate})"


def fit_rates(mass: DataFrame, weights: list[float], budget: float = 1.0, low: float = 0.0, high: float | None = None) -> Rates:
    """The fitted rates of rows (n_tokens, p)."""
    k = len(weights)
    target = np.array(weights, float) / sum(weights)
    at = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(y):
        """Totals, Gram matrix of the rows with a free rate, and the dual loss without its term in the goal."""
        free = f"r > {low!r}D" + ("" if high is None else f" AND r < {high!r}D")
        rows = mass.selectExpr(f"{rate_expression(y, low, high)} AS r", "n_tokens AS n", "p").withColumn("f", F.expr(f"IF({free}, n, 0D)"))
        dot = " + ".join(f"p[{i}] * {float(v)!r}D" for i, v in enumerate(y))
        row = rows.agg(
            *[F.sum(F.expr(f"r * n * p[{i}]")) for i in range(k)], *[F.sum(F.expr(f"f * p[{i}] * p[{j}]")) for i, j in at],
            F.sum(F.expr(f"n * (0.5D * (r - 1D) * (r - 1D) + r * ({dot}))"))).first()
        found = np.array([x or 0.0 for x in row])
        gram = np.zeros((k, k))
        for (i, j), x in zip(at, found[k:]):
            gram[i, j] = gram[j, i] = x
        return found[:k], gram, found[-1]

    y = np.zeros(k)
    now = np.array([x or 0.0 for x in mass.agg(*[F.sum(F.expr(f"n_tokens * p[{i}]")) for i in range(k)]).first()])
    if now.sum() <= 0:
        return Rates(rate_expression(y, low, high), target.tolist(), 0.0, False)
    goal, live = target * budget * now.sum(), now > 0
    stay = STAY * np.where(live, now, 1.0)
    reached, gram, value = sums(y)
    loss = lambda y, value: goal @ y - value + stay @ (y * y) / 2
    here, steps = loss(y, value), 0
    while steps < STEPS:
        error = np.where(live, reached - goal - stay * y, 0.0)
        if np.abs(error).max() <= TOLERANCE * now.sum():
            break
        move = np.linalg.solve(gram + np.diag(stay), error)
        size = 1.0
        while True:
            steps += 1
            new = sums(y + size * move)
            ahead = loss(y + size * move, new[2])
            if ahead <= here - 1e-4 * size * (error @ move) or size < 1e-6:
                break
            size /= 2
        done = here - ahead <= TOLERANCE * 1e-3 * abs(here)
        if ahead <= here:
            y, here, (reached, gram, value) = y + size * move, ahead, new
        if done:
            break
    share = reached / max(reached.sum(), 1e-9)
    missed = bool(abs(share - target).max() > MISSED or abs(reached.sum() / goal.sum() - 1) > MISSED)
    if missed:
        LOG.warning("mixture off its target after %d steps: shares %s of %.0f tokens, wanted %s of %.0f", steps, share.round(4).tolist(),
                    reached.sum(), target.round(4).tolist(), goal.sum())
    return Rates(rate_expression(y, low, high), share.tolist(), float(reached.sum()), missed)


def copies(rate):
    """How often a document is taken: the rate's whole part, and one more by chance for the rest."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit(37)), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(rate + chance).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float = 1.0, low: float = 0.0,
        high: float | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies of every row, and reached_<domain>, the shares that the rates reach (the same everywhere)."""
    k = len(DOMAINS)
    models = fit_posteriors(docs, label_domains(labels), k)
    mass = written(posteriors(docs, models, k), "posteriors")
    fitted = fit_rates(mass, [weights[d] for d in DOMAINS], budget, low, high)
    return mass.withColumn("rate", F.expr(fitted.rate)).select(
        "doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate",
        copies(F.col("rate")).alias("copies"), *[F.lit(s).alias(f"reached_{d}") for d, s in zip(DOMAINS, fitted.shares)])


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float = 1.0, low: float = 0.0,
          high: float | None = None, taught: DataFrame | None = None) -> DataFrame:
    """The documents, each as often as its rate says, all columns as they were; the classifier learns from ``taught``, else from docs."""
    k = len(DOMAINS)
    models = fit_posteriors(docs if taught is None else taught, label_domains(labels), k)
    keyed = posteriors(docs, models, k).select("n_tokens", "p")
    rate = fit_rates(written(keyed, "posteriors"), [weights[d] for d in DOMAINS], budget, low, high).rate
    # The rate is a function of the posterior, which is predicted again on the rows themselves: no join, no shuffle.
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            if not own:
                yield pd.Series([[1 / k] * k] * len(texts))
                continue
            base, _ = linear.margins(texts, np.stack([m.weights for m in own]))
            p = np.stack([m.probability(base[:, i] + m.intercept) for i, m in enumerate(own)], axis=1) + 1e-9
            yield pd.Series(list(p / p.sum(axis=1, keepdims=True)))
        trim()

    taken = wrapped(docs, doc_id=col("doc_id"), p=predict(col("text"))).withColumn("n", copies(F.expr(rate))).where("n > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
