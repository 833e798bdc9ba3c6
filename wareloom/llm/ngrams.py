"""Hashed n-gram indicators of texts and a linear scorer over them, in numpy inside Spark tasks.

A text's features are the distinct hashed values of: its lower-cased words without surrounding punctuation, pairs of
neighbouring words, byte trigrams (case kept), whether a word follows itself, in steps of powers of two, and the
share of words that do, in eighths. A text without any has the empty set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .words import Rolled, Words, batches, scramble

WORD_BITS, GRAM_BITS = 18, 14
REPEATS = 16
#: Bytes of text that are taken apart at a time: each byte costs some two hundred for a moment.
SCORED = 1 << 18
DIMENSIONS = (1 << WORD_BITS) + (1 << GRAM_BITS) + REPEATS

#: Words end at ASCII bytes that are no letters or digits.
PUNCTUATION = np.array([not chr(i).isalnum() if i < 128 else False for i in range(256)])


def indicators(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, ordered by text."""
    n = len(texts)
    with np.errstate(over="ignore"):
        lower = Words([t.lower() for t in texts], PUNCTUATION)
        h, own = lower.hash, lower.text
        found = [(own, h >> np.uint64(64 - WORD_BITS))]
        same = own[1:] == own[:-1]
        pairs = scramble(h[:-1] * np.uint64(3) + h[1:])[same]
        found.append((own[1:][same], pairs >> np.uint64(64 - WORD_BITS)))
        keys = np.unique(np.concatenate([(t.astype(np.uint64) << np.uint64(WORD_BITS)) | f for t, f in found]))
        text = (keys >> np.uint64(WORD_BITS)).astype(np.int64)
        feature = (keys & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)

        full = Words(texts)
        b = full.bytes.astype(np.uint32)
        grams = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435769) >> np.uint32(32 - GRAM_BITS)
        # Of a text's bytes and the line end behind it: a trigram must not reach into the next text.
        inner = np.maximum(full.text_end - full.text_start - 1, 0)
        at = np.repeat(np.arange(n), inner)
        place = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + np.repeat(full.text_start, inner)
        flags = np.zeros(n << GRAM_BITS, bool)
        flags[(at << GRAM_BITS) + grams[place]] = True
        where = np.flatnonzero(flags)

        again = np.flatnonzero((full.hash[1:] == full.hash[:-1]) & (full.text[1:] == full.text[:-1]))
        times = np.bincount(full.text[again], minlength=n)
    repeated = np.flatnonzero(times)
    step = np.minimum(np.log2(times[repeated]).astype(np.int64), 7)
    share = 8 + np.minimum(8 * times[repeated] // np.maximum(full.count[repeated], 1), 7)
    text = np.concatenate([text, where >> GRAM_BITS, repeated, repeated])
    feature = np.concatenate([feature, (where & ((1 << GRAM_BITS) - 1)) + (1 << WORD_BITS),
                              step + (1 << WORD_BITS) + (1 << GRAM_BITS), share + (1 << WORD_BITS) + (1 << GRAM_BITS)])
    order = np.argsort(text, kind="stable")
    return text[order], feature[order]


def as_bytes(texts: pd.Series) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in texts]


def sets(texts: pd.Series) -> list[np.ndarray]:
    """The features of each text."""
    out = []
    for group in batches(as_bytes(texts), SCORED):
        text, feature = indicators(group)
        out += np.split(feature, np.searchsorted(text, np.arange(1, len(group))))
    return out


def flat(frames, columns: dict[str, type], by: list[str]) -> tuple[pd.DataFrame, list[tuple[np.ndarray, ...]]]:
    """(other columns, rows of views into flat arrays), ordered by columns; no frame outlives its turn."""
    rest, rows = [], []
    for f in frames:
        data = [np.frombuffer(b"".join(f[c]), kind) for c, kind in columns.items()]
        cut = np.cumsum(f[next(iter(columns))].str.len().to_numpy(np.int64) // np.dtype(next(iter(columns.values()))).itemsize)
        rows += zip(*[np.split(x, cut[:-1]) for x in data]) if len(f) else []
        rest.append(f.drop(columns=list(columns)))
        del data
    if not rest:
        return pd.DataFrame(columns=by), []
    held = pd.concat(rest, ignore_index=True).sort_values(by, kind="stable")
    return held, [rows[i] for i in held.index]


def margins(texts: pd.Series, weights: np.ndarray, unit: bool = True) -> np.ndarray:
    """texts x models: sums of the weights (models x DIMENSIONS) over a text's features, divided by the set's norm."""
    out = []
    for group in batches(as_bytes(texts), SCORED):
        text, feature = indicators(group)
        size = np.maximum(np.bincount(text, minlength=len(group)), 1)
        rows = [np.bincount(text, weights=w[feature], minlength=len(group)) for w in weights]
        out.append(np.stack(rows, axis=1) / (np.sqrt(size)[:, None] if unit else 1))
    return np.concatenate(out) if out else np.zeros((0, len(weights)))
