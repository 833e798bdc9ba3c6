"""Sparse linear models over word-beginning densities, shared by classifiers of whole texts.

Features of a text: its words, lower-cased and without punctuation, their first 5, 6 and 7 bytes, what stands between a word and
the next, and whether a word repeats the one before, all hashed; a feature's value is its occurrences per (words + 20) words times 50, so that long and short texts compare. Values are scaled by the classes'
log-count ratio, which counts as far as the classes' shares of texts with the feature differ by more than ``NOISE`` standard errors: among
many features of few labelled texts most ratios are chance. Weights come from dual coordinate descent on the hinge loss; margins of rows that a fold's model
has not seen give the logistic curve that turns margins into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from .ngrams import PUNCTUATION, SCORED, as_bytes
from .quality import logistic_curve
from .words import Rolled, Words, batches

BITS = 18
SIZE = 1 << BITS
BEGINNINGS = (5, 6, 7, 1 << 30)
FOLDS = 5
PASSES = 10
#: A ratio counts in full from NOISE + 1 standard errors on, and not at all below NOISE.
NOISE = 2.0


def _hashed(group: list[bytes]):
    """(words, features of each word by kind of beginning)."""
    with np.errstate(over="ignore"):
        words = Words([t.lower() for t in group], PUNCTUATION)
        rolled = Rolled(words.bytes.astype(np.uint64) + np.uint64(1))
        kinds = []
        for i, n in enumerate(BEGINNINGS):
            h = rolled.hash(words.start, np.minimum(words.start + n, words.end))
            kinds.append((h * np.uint64(2 * i + 3)) >> np.uint64(64 - BITS))
        following = np.append(words.start[1:], len(words.bytes))
        gap = rolled.hash(words.end, np.minimum(following, words.text_end[words.text])) if len(words.start) else words.hash
        kinds.append((gap * np.uint64(17)) >> np.uint64(64 - BITS))
        again = np.zeros(len(words.hash), np.uint64)
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
        kinds.append(again)
    return words, kinds


def densities(texts: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, values) of each text."""
    out = []
    for group in batches(as_bytes(texts), SCORED):
        words, kinds = _hashed(group)
        owner = words.text.astype(np.uint64) << np.uint64(BITS)
        key, times = np.unique(np.concatenate([owner | f for f in kinds]), return_counts=True)
        feature = (key & np.uint64(SIZE - 1)).astype(np.int32)
        cut = np.searchsorted(key >> np.uint64(BITS), np.arange(1, len(group)))
        for f, n, total in zip(np.split(feature, cut), np.split(times, cut), words.count):
            out.append((f, (n * (50 / (total + 20))).astype(np.float32)))
    return out


def margins(texts: pd.Series, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x models margins without intercepts, words of each text); linear, so occurrences need not be counted."""
    out, sizes = [], []
    for group in batches(as_bytes(texts), SCORED):
        words, kinds = _hashed(group)
        kinds = [f.astype(np.int64) for f in kinds]
        rows = [np.bincount(words.text, weights=sum(w[f] for f in kinds), minlength=len(group)) for w in weights]
        out.append(np.stack(rows, axis=1) * (50 / (words.count + 20))[:, None])
        sizes.append(words.count)
    return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros((0, len(weights))), np.zeros(0, np.int64))


@dataclass
class Model:
    """weights: of the features; more: of the further inputs."""

    weights: np.ndarray
    more: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, rows, extra: np.ndarray) -> np.ndarray:
        return np.array([self.weights[f] @ v for f, v in rows]) + extra @ self.more + self.intercept

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _fit(rows, extra: np.ndarray, y: np.ndarray) -> Model:
    seen = np.zeros((2, SIZE))
    for (f, _), k in zip(rows, y):
        seen[int(k > 0)][f] += 1  # a text's features are distinct
    share = np.log(seen + 0.5) - np.log((seen + 0.5).sum(axis=1, keepdims=True))
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    both = (seen.sum(axis=0) + 1) / (n1 + n0 + 2)
    errors = np.abs(seen[1] / n1 - seen[0] / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    ratio = np.where(seen.any(axis=0), share[1] - share[0], 0.0) * np.clip(errors - NOISE, 0, 1)
    rows = [(f[own], v[own]) for f, v in rows for own in (ratio[f] != 0,)]
    sign = np.where(y > 0, 1.0, -1.0)
    bound = 0.5 / np.maximum(np.where(y > 0, y.mean(), 1 - y.mean()), 1e-9)
    # Scaled rows are not kept: w stands for the weights times the ratios.
    square = ratio * ratio
    norm = np.array([float((v * v) @ square[f]) for f, v in rows]) + (extra * extra).sum(axis=1) + 1.0
    w, more, b = np.zeros(SIZE), np.zeros(extra.shape[1]), 0.0
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(1)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            f, v = rows[i]
            new = min(max(alpha[i] - (sign[i] * (w[f] @ v + extra[i] @ more + b) - 1) / norm[i], 0.0), bound[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[f] += step * (square[f] * v)
                more += step * extra[i]
                b += step
                alpha[i] = new
    return Model(w.astype(np.float32), more, b)


def out_of_fold(rows, extra: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[Model, np.ndarray]:
    """(model of all rows, with the curve of unseen margins; each row's probability by a model that has not seen it)."""
    margin = np.zeros(len(rows))
    for k in range(FOLDS):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if not len(own) or not len(rest):
            continue
        if len(set(y[rest])) < 2:
            margin[own] = 1.0 if y[rest[0]] > 0 else -1.0
            continue
        margin[own] = _fit([rows[i] for i in rest], extra[rest], y[rest]).margin([rows[i] for i in own], extra[own])
    model = _fit(rows, extra, y)
    model.slope, model.offset = logistic_curve(margin, y)
    return model, model.probability(margin)
