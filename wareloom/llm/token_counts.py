"""Token counts of a byte-level byte-pair tokenizer from compiled finite-state transducers.

Two deterministic transducers are composed. The first splits text into pre-tokens; its eleven states read character
classes, and its transition monoid is small, so that the state map of any chunk is one number, chunks are mapped side
by side, and the maps compose through a parallel prefix scan: no chunk waits for the one before it. The second
(``bpe.Transducer``) reads a pre-token's bytes and sums the token counts on its transitions; counts of pre-tokens
that came before are looked up.

Counts equal those of the library that the file is for, without added begin or end tokens; the file's special
tokens inside a text count one each and split it, as is the library's default.

Edge cases: a null or empty text has 0 tokens; texts are never cut, a text longer than a batch is a batch of its own; rows
with equal or null doc_id are counted row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Pairs, Recent, Transducer
from .common import col, ship

BATCH_CHARS = 4 << 20
LANE = 512

CLASSES = ("letter", "stmd", "rv", "e", "l", "number", "other", "apostrophe", "space", "blank", "end")
STATES = ("fresh", "letters", "numbers", "others", "apostrophe", "re_ve", "ll", "space", "spaces", "blank", "blanks")
LETTERS = {"letter", "stmd", "rv", "e", "l"}
#: Bits of a transition's output: the character read, or the one before it, starts a pre-token.
HERE, BEFORE = 1, 2


def begin(c: str) -> tuple[str, int]:
    if c in LETTERS:
        return "letters", HERE
    return {"number": ("numbers", HERE), "other": ("others", HERE), "apostrophe": ("apostrophe", HERE),
            "space": ("space", HERE), "blank": ("blank", HERE), "end": ("fresh", 0)}[c]


def inside(kind: str, c: str) -> tuple[str, int]:
    """Within a run of letters, numbers or others."""
    runs = {"letters": LETTERS, "numbers": {"number"}, "others": {"other", "apostrophe"}}
    return (kind, 0) if c in runs[kind] else begin(c)


def joined(c: str) -> str:
    """The run that a character after a single space continues."""
    return "letters" if c in LETTERS else "numbers" if c == "number" else "others"


def step(state: str, c: str) -> tuple[str, int]:
    if state == "fresh":
        return begin(c)
    if state in ("letters", "numbers", "others"):
        return inside(state, c)
    if state == "apostrophe":  # 's 't 'm 'd, or the first two characters of 're 've 'll
        if c in ("stmd", "rv", "l"):
            return {"stmd": "fresh", "rv": "re_ve", "l": "ll"}[c], 0
        return inside("others", c)
    if state in ("re_ve", "ll"):
        if c == ("e" if state == "re_ve" else "l"):
            return "fresh", 0
        to, out = inside("letters", c)
        return to, out | BEFORE
    if c == "end":
        return "fresh", 0
    if c in ("space", "blank"):
        return c + "s", 0
    late = BEFORE if state in ("spaces", "blanks") else 0
    if state in ("space", "spaces"):
        return joined(c), late
    to, out = begin(c)
    return to, out | late


class Splitter:
    """The first transducer with the monoid of its state maps."""

    def __init__(self):
        n = len(STATES)
        arcs = [[step(s, c) for c in CLASSES] for s in STATES]
        self.out = np.array([[o for _, o in row] for row in arcs], np.uint8).ravel()
        moves = [tuple(STATES.index(row[c][0]) for row in arcs) for c in range(len(CLASSES))]
        maps, index = [tuple(range(n))], {tuple(range(n)): 0}
        right = []
        for m in maps:  # grows as new maps are found
            row = []
            for move in moves:
                x = tuple(move[s] for s in m)
                if x not in index:
                    index[x] = len(maps)
                    maps.append(x)
                row.append(index[x])
            right.append(row)
        self.right = np.array(right, np.uint16).ravel()
        self.apply = np.array(maps, np.uint8)
        self.compose = np.array([[index[tuple(b[s] for s in a)] for b in maps] for a in maps], np.uint16)

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Whether each character starts a pre-token; classes must end with an end mark."""
        n, c = len(classes), len(CLASSES)
        lanes = -(-n // LANE)
        padded = np.full(lanes * LANE, c - 1, np.uint8)
        padded[:n] = classes
        columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
        before = np.empty((LANE, lanes), np.uint16)
        m = np.zeros(lanes, np.uint16)
        for j in range(LANE):  # state maps of all chunks, side by side
            before[j] = m
            m = self.right[m.astype(np.int32) * c + columns[j]]
        d = 1
        while d < lanes:  # parallel prefix scan over the chunks' maps
            m = np.concatenate([m[:d], self.compose[m[:-d], m[d:]]])
            d *= 2
        entry = np.concatenate(([0], self.apply[m[:-1], 0]))
        state = self.apply[before, entry[None, :]]
        out = self.out[state.astype(np.int32) * c + columns].T.ravel()[:n]
        found = (out & HERE) > 0
        found[:-1] |= (out[1:] & BEFORE) > 0
        return found


@lru_cache(1)
def splitter() -> Splitter:
    return Splitter()


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, CLASSES.index("other"), np.uint8)
    for pattern, name in ((r"\p{L}", "letter"), (r"\p{N}", "number"), (r"\s", "blank")):
        table[[ord(x) for x in regex.findall(pattern, every)]] = CLASSES.index(name)
    for chars, name in (("stmd", "stmd"), ("rv", "rv"), ("e", "e"), ("l", "l"), ("'", "apostrophe"), (" ", "space")):
        table[[ord(x) for x in chars]] = CLASSES.index(name)
    # The pattern's white space has no information separators.
    table[0x1C:0x20] = CLASSES.index("other")
    return table


def byte_alphabet() -> dict[str, str]:
    """The printable stand-ins of the file format, back to bytes (as characters below 256)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): chr(b) for b in own} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class Counter(Recent):
    """Token counts by pre-token; unknown ones are read by the transducer."""

    def __init__(self, file: bytes):
        super().__init__()
        spec = json.loads(file)
        kind, model = spec["pre_tokenizer"], spec["model"]
        plain = spec.get("normalizer") is None and kind["type"] == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"]
        if not plain or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE files without a normaliser are compiled")
        back = byte_alphabet()
        decode = lambda s: "".join(back[x] for x in s)
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space are not compiled")
        self.special = sorted(special, key=len, reverse=True)
        tokens = {decode(t) for t in model["vocab"] if t not in special}
        ranks = {}
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks[decode(a), decode(b)] = i
        self.transducer = Transducer(Pairs(tokens, lambda a, b: ranks.get((a, b))))

    def make(self, word: str) -> int:
        return self.transducer.count(word.encode().decode("latin-1"))

    def segments(self, text: str) -> list[str]:
        parts = [text]
        if any(s in text for s in self.special):
            import re

            parts = re.split("|".join(map(re.escape, self.special)), text)
        return parts

    def counts(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = self.segments(t)
            extra[i] = len(own) - 1
            parts += own
            owner += [i] * len(own)
        lengths = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        whole = "\n".join(parts) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        classes = class_table()[codes]
        classes[ends] = len(CLASSES) - 1
        cut = splitter().starts(classes)
        cut[ends] = True
        at = np.flatnonzero(cut)
        bounds = at.tolist()
        n = np.fromiter(map(self.__getitem__, [whole[i:j] for i, j in zip(bounds, [*bounds[1:], len(whole)])]), np.int64, len(bounds))
        n[classes[at] == len(CLASSES) - 1] = 0
        part = np.searchsorted(ends, at)
        per_part = np.bincount(part, weights=n, minlength=len(parts)).astype(np.int64)
        return extra + np.bincount(np.array(owner, np.int64), weights=per_part, minlength=len(texts)).astype(np.int64)


_compiled: dict[int, Counter] = {}


def compiled(file: bytes) -> Counter:
    key = hash(file)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Counter(file)
    return _compiled[key]


def counter(spark: SparkSession, path: str):
    """A pandas UDF from text to its number of tokens. The file is read here, once, and travels to the executors."""
    ship(spark)
    with open(path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())  # a vocabulary, of fixed size

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        machine, out, held, size = compiled(file.value), [], [], 0
        for t in texts:
            t = t if isinstance(t, str) else ""
            if held and size + len(t) > BATCH_CHARS:
                out.append(machine.counts(held))
                held, size = [], 0
            held.append(t)
            size += len(t)
        if held:
            out.append(machine.counts(held))
        return pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))

    return n_tokens


def count(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    n = counter(docs.sparkSession, path)
    text = F.coalesce(col("text"), F.lit(""))
    counted = docs.select(col("doc_id").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
