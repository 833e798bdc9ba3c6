"""Grouping of spelling variants by finite-state composition.

Words are the runs ``[A-Za-zÀ-ÿ]+`` with A-Z in lower case; a seeded share of the occurrences gets a misspelling (one
code point left out). Two words are near if one code point is inserted, deleted or replaced. A word's form is
its most frequent near word, if that is ``TIMES`` times as frequent; its root is where the forms lead.

The near pairs are the pairs that the vocabulary's minimised acceptor, composed with a one-edit transducer and the acceptor again,
accepts. The composition is partitioned by initial state: for pairs whose shorter word has m code points and whose first
difference lies at place p, [a, b) being a part of the places 0..m with a <= p < b, both words have the same first a and last m - b code
points. These choose the initial state, and what lies between is read by the acceptors. Each word goes to four
partitions (m = its length or one less; p in the first or second half), each pair is found in exactly one. A partition with more
than ``LIMIT`` words is cut again at the middle of its [a, b), down to one place, where at most the alphabet is left; so
no partition grows without bound, whatever the words are.

Within a partition the acceptor is built minimised (equal right languages are one state), the words of m and of m + 1 code points from
two start states. Composed states are pairs of these: before the edit both sides read the same code point, the edit
replaces or inserts one, and behind it the common right language of two states is enumerated (of equal states, all of it; known
pairs are looked up).

Edge cases: a null text has no words; a null doc_id counts as the empty text in the hashed string; texts and words are never cut; rows
that repeat count again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, ship, trim, written

#: The contract's numbers: shortest word, least occurrences, a form's frequency against its variant's, one misspelling in so many.
LENGTH, OCCURRENCES, TIMES, EVERY = 7, 2, 10, 31
#: Words of a partition of the composition.
LIMIT = 20_000
#: Distinct words that a counting task holds, and composed states that a composing task holds.
HELD, STATES = 200_000, 300_000
#: Code points that the acceptors read; longer middles are cut at their half first.
REACH = 64
LONG_RUNS = re.compile(f"[a-zÀ-ÿ]{{{LENGTH},}}").findall


def occurrences(doc_id: str, text: str, every: int = EVERY) -> Iterator[tuple[str, int]]:
    """(word, count) of the runs of at least LENGTH code points, misspellings included; shorter ones never become words."""
    salt = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(LONG_RUNS(text.encode().lower().decode())).items():  # bytes.lower changes A-Z only
        h = zlib.crc32(run.encode(), salt)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LENGTH:
                continue
        yield run, n


def vocabulary(docs: DataFrame, least: int = OCCURRENCES) -> DataFrame:
    """word, n: words of at least LENGTH code points with at least so many occurrences."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def frame():
            return pd.DataFrame({"word": list(held), "n": list(held.values())})

        for f in frames:
            for doc_id, text in zip(f["doc_id"], f["text"]):
                for word, n in occurrences(doc_id, text):
                    held[word] += n
                if len(held) > HELD:
                    yield frame()
                    held.clear()
        if held:
            yield frame()
        held.clear()
        trim()

    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {least}")


class Acceptors:
    """Minimised acceptors of sets of words of equal length; equal states of all of them are one."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        #: arcs of each state, as (code point, state); state 0 accepts and has no arcs
        self.arcs: list[tuple] = [()]
        self.known: dict[tuple, int] = {(): 0}
        self.both: dict[tuple[int, int], list[str]] = {}

    def state(self, arcs: tuple) -> int:
        found = self.known.get(arcs)
        if found is None:
            found = self.known[arcs] = len(self.arcs)
            self.arcs.append(arcs)
        return found

    def build(self, words: list[str]) -> int:
        """The start state of sorted distinct words of equal length: a path is folded once the next word leaves it."""
        path: list[list] = [[] for _ in range(len(words[0]) + 1)]
        last = ""
        for w in [*words, ""]:
            same = 0
            while same < len(w) and same < len(last) and w[same] == last[same]:
                same += 1
            for i in range(len(last), same, -1):
                path[i - 1].append((last[i - 1], self.state(tuple(path[i]))))
                path[i] = []
            last = w
        return self.state(tuple(path[0]))

    def language(self, p: int) -> list[str]:
        """The words that lead from p to the end."""
        return self.common(p, p)

    def common(self, p: int, q: int) -> list[str]:
        """The words that lead from both to the end."""
        if p > q:
            p, q = q, p
        if p == 0:
            return [""] if q == 0 else []
        found = self.both.get((p, q))
        if found is None:
            other = dict(self.arcs[q])
            found = self.both[p, q] = [c + x for c, to in self.arcs[p] if c in other for x in self.common(to, other[c])]
        return found

    def replaced(self, p: int) -> Iterator[tuple[str, str]]:
        """Pairs of words from p that differ in one code point."""
        arcs = self.arcs[p]
        for i, (c, to) in enumerate(arcs):
            for d, on in arcs[i + 1 :]:
                for x in self.common(to, on):
                    yield c + x, d + x
            for x, y in self.replaced(to):
                yield c + x, c + y

    def inserted(self, p: int, q: int, last: bool) -> Iterator[tuple[str, str]]:
        """Pairs (word from p, word from q) of which the second has one code point more; first difference behind the first
        word's end only if last."""
        own = dict(self.arcs[p])
        for c, to in self.arcs[q]:
            for x in self.common(p, to):
                if x[:1] != c and (x or last):  # a run's further code point counts as put behind the run
                    yield x, c + x
            if c in own:
                for x, y in self.inserted(own[c], to, last):
                    yield c + x, c + y


def _local_parts(short: list[tuple[str, int]], long: list[tuple[str, int]], head: str, tail: str, last: bool):
    """A partition cut, as often as needed, into partitions whose middles have REACH code points at most."""
    stack = [(short, long, head, tail, last)]
    while stack:
        short, long, head, tail, last = stack.pop()
        size = len(short[0][0])
        if size <= REACH:
            yield short, long, head, tail, last
            continue
        half = size // 2
        back = size - half
        parts: dict[tuple[bool, str], tuple[list, list]] = {}
        for kind, rows in enumerate((short, long)):
            for w, n in rows:
                parts.setdefault((False, w[len(w) - back :]), ([], []))[kind].append((w[: len(w) - back], n))
                parts.setdefault((True, w[:half]), ([], []))[kind].append((w[half:], n))
        for (second, shared), (a, b) in parts.items():
            if a and len(a) + len(b) > 1:
                stack.append((a, b, head + shared, tail, last) if second else (a, b, head, shared + tail, False))


def near_of(machine: Acceptors, short: list[tuple[str, int]], long: list[tuple[str, int]], head: str, tail: str, last: bool) -> list[tuple]:
    """(word, near words, most frequent near word's n, that word) of a partition; short and long are sorted (middle, n)."""
    out = []
    for short, long, head, tail, last in _local_parts(short, long, head, tail, last):
        n = dict(short + long)  # the lengths tell them apart
        found: dict[str, tuple[int, int, str]] = {}

        def meet(x: str, y: str) -> None:
            for word, other in ((x, y), (y, x)):
                seen, most, best = found.get(word, (0, 0, ""))
                m = n[other]
                if m > most or m == most and other + tail < best + tail:
                    most, best = m, other
                found[word] = seen + 1, most, best

        start = machine.build([w for w, _ in short])
        for x, y in machine.replaced(start):
            meet(x, y)
        if long:
            for x, y in machine.inserted(start, machine.build([w for w, _ in long]), last):
                meet(x, y)
        out += [(head + w + tail, seen, most, head + best + tail) for w, (seen, most, best) in found.items()]
    return out


KEY = ["m", "a", "b", "head", "tail"]


def _partitioned(words: DataFrame) -> DataFrame:
    """The rows (word, n, m, a, b) with their partition: head and tail, and what lies between as middle."""
    tail = "greatest(m + 1 - b, 1) - 1"  # m - b code points, none where b = m + 1
    return words.selectExpr(
        "n", "m", "a", "b", "substring(word, 1, a) AS head", f"right(word, {tail}) AS tail",
        f"substring(word, a + 1, char_length(word) - a - ({tail})) AS middle", "int(char_length(word) > m) AS longer")


def _halves(rows: DataFrame) -> DataFrame:
    """Each (word, n, m, a, b) with its places cut at the middle."""
    return rows.selectExpr("word", "n", "m", "explode(array(struct(a AS a, (a + b) div 2 AS b), struct((a + b) div 2 AS a, b AS b))) AS r").selectExpr(
        "word", "n", "m", "int(r.a) AS a", "int(r.b) AS b")


def near(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n_near, best_n, best: of each word with near words, how many in a partition and the most frequent one."""
    ship(words.sparkSession)
    classes = words.selectExpr("word", "n", f"explode(filter(array(char_length(word), char_length(word) - 1), x -> x >= {LENGTH})) AS m")
    rows = _halves(classes.selectExpr("word", "n", "m", "0 AS a", "m + 1 AS b"))
    schema = "word string, n_near long, best_n long, best string"

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, key, sets, out = Acceptors(), None, ([], []), []

        def done():
            short, long = sets
            if short and len(short) + len(long) > 1:
                m, a, b, head, tail = key
                out.extend(near_of(machine, short, long, head, tail, b > m))
                if len(machine.arcs) + len(machine.both) > STATES:
                    machine.forget()

        for f in frames:
            for m, a, b, head, tail, middle, longer, n in f.itertuples(index=False, name=None):
                if key != (m, a, b, head, tail):
                    done()
                    key, sets = (m, a, b, head, tail), ([], [])
                sets[longer].append((middle, n))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])
                out.clear()
        done()
        if out:
            yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])
        trim()

    found = None
    while True:
        dealt = _partitioned(rows)
        # Partitions are counted first, so that none above the limit ever meets in one task.
        large = written(dealt.groupBy(*KEY).agg(F.count("*").alias("size")).where(f"size > {limit} AND b - a > 1").select(*KEY), "near-large")
        any_large = not large.isEmpty()
        fit = dealt.join(large, KEY, "left_anti") if any_large else dealt
        part = fit.select(*KEY, "middle", "longer", "n").repartition(*KEY).sortWithinPartitions(*KEY, "longer", "middle").mapInPandas(
            compose, schema)
        found = part if found is None else found.unionByName(part)
        if not any_large:
            return found
        again = dealt.join(large, KEY, "left_semi")
        rows = written(_halves(again.selectExpr("concat(head, middle, tail) AS word", "n", "m", "a", "b")), "near-again")


def variants(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(vocabulary(docs), "words")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("n_near", "long"), ("best_n", "long"), ("best", "string"))]
    all_ = words.select("word", "n", *none).unionByName(
        near(words, limit).select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    told = all_.groupBy("word").agg(F.max("n").alias("n"), F.coalesce(F.sum("n_near"), F.lit(0)).alias("n_near"), best.alias("b"))
    enough = -F.col("b.less") >= TIMES * F.col("n")
    told = written(told.select(
        "word", "n", "n_near", F.when(enough, F.col("b.best")).alias("form"), F.when(enough, -F.col("b.less")).alias("form_n")), "word-forms")
    # Forms grow tenfold in frequency a step, so few doublings reach every root.
    roots = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                        "word-roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return told.join(roots.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
