import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wareloom.llm import passages
from wareloom.llm.words import Rolled, Words

SCHEMA = "doc_id long, text string, th string, h int"


def brute(rows, width=20):
    """Windows by their words, in the order of (doc_id, start), nulls first."""
    seen, out = {}, Counter()
    split = [(-(10**9) if d is None else d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            seen[k] = min(seen.get(k, (d, i)), (d, i))
    for (d, t, *_), (key, w) in zip(rows, split):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] < (key, i):
                gone |= set(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def corpus(seed, n=60, words=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 80))] for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.6:
                s = rng.choice(shared)
                a = rng.randint(0, len(s) - 1)
                parts += s[a : a + rng.randint(5, 80)]
            else:
                parts += [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        rows.append((i * 3 % 101, rng.choice([" ", "\n", "\t "]).join(parts), "x", 1))
    return rows


@pytest.mark.parametrize("seed,words", [(1, 30), (2, 500), (3, 2), (4, 1)])
def test_against_brute_force(spark, seed, words):
    rows = corpus(seed, words=words)
    assert got(passages.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_edges(spark):
    base = " ".join(f"u{i}" for i in range(25))
    rows = [(1, base, "x", 1), (1, base, "x", 1), (1, base + " more", None, None), (2, None, "x", 1), (3, "", "x", 1), (None, base, "x", 1),
            (4, "é x y " * 30, "x", 1), (5, " ".join(["same"] * 500), "x", 1), (6, "word " * 30_000, "x", 1), (7, "x" * 300_000, "x", 1)]
    assert got(passages.dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_kept_text(spark):
    rows = corpus(5)
    for r in passages.dedup(spark.createDataFrame(rows, SCHEMA), with_text=True).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_hashes_do_not_depend_on_the_batch():
    with np.errstate(over="ignore"):
        one, two = Words([b"a bc def"]), Words([b"zz top", b"", b"a bc def", b"q"])
        assert list(one.hash) == list(two.hash[2:5]) and len(set(two.hash.tolist())) == 6
        assert Rolled(one.hash).hash(np.array([0]), np.array([3])) == Rolled(two.hash).hash(np.array([2]), np.array([5]))


def test_empty(spark):
    assert passages.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_frequent_phrase_is_spread_over_groups(spark, monkeypatch):
    """A phrase of 18 words among different words: as if of very many contents, against brute force."""
    monkeypatch.setattr(passages, "SPLIT", 20)
    rng, phrase = random.Random(8), " ".join(f"p{i}" for i in range(18))
    around = lambda: " ".join(f"x{rng.randint(0, 10**6)}" for _ in range(25))
    rows = [(i, f"{around()} {phrase} {around()}", "x", 1) for i in range(150)]
    rows += [(500 + i, r[1] + " " + around(), "x", 1) for i, r in enumerate(rows[:60])] + [(900 + i, *r[1:]) for i, r in enumerate(corpus(3, words=40))]
    assert got(passages.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)
    with np.errstate(over="ignore"):
        words = Words([r[1].encode() for r in rows])
        _, _, _, h, u = passages.blocks(words, Rolled(words.hash), 20)
        often = passages.contents(h, u)
        hot = often.h[often.n >= 20].to_numpy().view(np.uint64)
        mine = np.isin(h, hot)
        assert len(hot) and len(set(passages.dealt(h[mine], u[mine], 64, hot))) > 16
        assert (passages.dealt(h, u, 64, hot)[~mine] == h[~mine] % np.uint64(64)).all()
        same = np.full(1000, h[0])  # windows of one gram
        assert len(set(passages.dealt(same, np.arange(1000).astype(np.uint64), 64, None))) == 64


def test_copies_of_a_block_leave_its_group(spark):
    """However many documents hold a passage, its group gets one block of each batch; what is known goes by document."""
    rng = np.random.default_rng(1)
    for n in (1000, 20_000):
        did, th = np.arange(n), rng.integers(-(2**62), 2**62, n)
        one = np.full(n, 12345, np.uint64)
        with np.errstate(over="ignore"):
            frame = passages.packed(did, th, np.arange(n), np.zeros(n, np.int64), np.full(n, 30), one, one, 16, None)
        fresh = [np.frombuffer(p, np.int64, 3)[1] for p in frame["payload"]]
        sizes = frame["payload"].str.len()
        assert sum(fresh) == 1 and len(frame) == 16 and sizes.max() < 1.5 * sizes.median()
