import random
from collections import Counter

import numpy as np
import pytest

from wareloom.llm import near_copies
from wareloom.llm.common import written
from wareloom.llm.components import components

SCHEMA = "doc_id long, text string, node string, label string, row int"


def chain(x, y):
    """Longest common subsequence by the full table."""
    best = [0] * (len(y) + 1)
    for a in x:
        before = 0
        for j, b in enumerate(y, 1):
            before, best[j] = best[j], before + 1 if a == b else max(best[j], best[j - 1])
    return best[-1]


def brute(rows):
    """Class of each row: equal texts, and pairs with similarity 0.8 or more."""
    texts = [t or "" for _, t, *_ in rows]
    labels = [x.tolist() for x in near_copies.kmers([t.encode() for t in texts])]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(labels[i]) + len(labels[j])
            common = len(set(labels[i]) & set(labels[j]))
            linked = texts[i] == texts[j]
            if not linked and common and common / (n - common) >= 0.8:
                m = chain(labels[i], labels[j])
                linked = m / (n - m) >= 0.8
            if linked:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, *_) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    out = Counter()
    for i, (d, *_) in enumerate(rows):
        ids = groups[find(i)]
        known = [x for x in ids if x is not None]
        out[d, min(known) if known else None, len(ids)] += 1
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.6:
            words[i] = f"e{rng.randrange(10**6)}"
        elif kind < 0.8:
            words.insert(i, f"i{rng.randrange(10**6)}")
        elif len(words) > 6:
            del words[i]
    return words


def corpus(seed):
    rng, rows = random.Random(seed), []
    for family in range(6):
        base = [f"f{family}w{rng.randrange(40 if family % 2 else 5000)}" for _ in range(rng.choice([6, 60, 150, 300]))]
        for _ in range(rng.choice([2, 5, 30])):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 25))))
    rows += [" ".join(f"z{rng.randrange(10**6)}" for _ in range(40)) for _ in range(10)]
    rng.shuffle(rows)
    return [(i * 7 % 1009, t, "n", "l", 1) for i, t in enumerate(rows)]


def got(df):
    return Counter((r.doc_id, r.class_id, r.class_size) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(near_copies.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(None, None, "n", "l", 1), (3, "", None, None, None), (4, "one two", "n", "l", 1), (5, "one  two", "n", "l", 1), (5, "one  two", "n", "l", 1),
            (6, "one two three", "n", "l", 1), (7, long, "n", "l", 1), (8, long + " end", "n", "l", 1), (9, "a " * 3000, "n", "l", 1),
            (10, "a " * 2900, "n", "l", 1), (None, "alone here", "n", "l", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(near_copies.dedup(docs)) == brute(rows)
    kept = near_copies.keep_one(docs).collect()
    assert set(kept[0].asDict()) == {"doc_id", "text", "node", "label", "row"}
    marked = [r for r in near_copies.dedup(docs).collect() if r.kept]
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in marked)
    assert len(kept) == len({(r.class_id, r.class_size) for r in near_copies.dedup(docs).collect()})


def test_similarity_equals_the_full_table():
    rng = random.Random(9)
    for _ in range(300):
        base = [f"w{rng.randrange(8 if rng.random() < 0.5 else 400)}" for _ in range(rng.randint(1, 60))]
        a, b = near_copies.kmers([" ".join(edited(rng, base, rng.randint(0, 3))).encode(), " ".join(edited(rng, base, rng.randint(0, 3))).encode()])
        m = chain(a.tolist(), b.tolist())
        exact = m / (len(a) + len(b) - m)
        found = near_copies.similarity(a, b)
        assert (abs(found - exact) < 1e-12) if exact >= 0.8 else found < 0.8


def test_meeting_probability():
    """Texts of similarity 0.8 share one of the sketches practically always."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (160, 20, 20))
        x, y = np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))
        assert (near_copies.sketches(x) == near_copies.sketches(y)).any()


@pytest.mark.parametrize("n", range(1, 14))
def test_short_texts_meet_for_sure(n):
    """Every pair of similarity 0.8 or more of which neither has more than SHORT k-mers shares a bucket, whichever k-mers differ."""
    rng, hashes = random.Random(n), np.random.default_rng(n)
    for _ in range(300):
        common = hashes.integers(0, 2**63, n, dtype=np.uint64)
        sides = []
        for _ in range(2):
            own = list(common)
            for _ in range(rng.randrange(4)):
                own.insert(rng.randrange(len(own) + 1), hashes.integers(0, 2**63, dtype=np.uint64))
            sides.append(np.array(own, np.uint64))
        x, y = sides
        if max(len(x), len(y)) <= near_copies.SHORT and near_copies.similarity(x, y) >= 0.8:
            assert set(near_copies.chains(x)) & set(near_copies.chains(y))
        assert bool(near_copies.chains(x)) == (len(x) <= near_copies.SHORT)


def test_short_texts_are_linked(spark):
    """Eight and nine words, one word put in at the end: similarity 4 / 5, which sketches alone miss once in two hundred times."""
    rows = []
    for i in range(400):
        words = [f"w{i}x{j}" for j in range(9)]
        rows += [(2 * i, " ".join(words[:8])), (2 * i + 1, " ".join(words))]
    got = {r.doc_id: r.class_id for r in near_copies.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(400))


def test_a_large_star_has_one_label(spark):
    """The centre of most edges, as a frequent text's class has it."""
    links = spark.range(1, 3000).selectExpr("lpad(id, 5, '0') AS a", "lpad(IF(id % 10 = 0, id - 1, 0), 5, '0') AS b")
    labels = {r.node: r.label for r in components(links).collect()}
    assert len(labels) == 3000 and set(labels.values()) == {"00000"}


def test_plans_of_rounds_stay_small(spark, monkeypatch):
    """The driver keeps every plan it ran: what a join reads several times is written before, and finished stars need no round."""
    from wareloom.llm import components as module

    plans = []
    monkeypatch.setattr(module, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    path = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(20)], "a string, b string")
    assert {r.label for r in components(path).collect()} == {"000"}
    assert max(p.count("Exchange") for p in plans) < 12
    plans.clear()
    star = spark.createDataFrame([("000", f"{i:03}") for i in range(1, 20)], "a string, b string")
    assert {r.label for r in components(star).collect()} == {"000"} and len(plans) == 1


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(150)] + [(900, 901)]
    frame = spark.createDataFrame([(str(a).zfill(4), str(b).zfill(4)) for a, b in pairs], "a string, b string")
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in parent if i != find(i) or any(find(j) == i and j != i for j in parent)}
    assert {int(r.node): int(r.label) for r in components(frame).collect()} == want


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_copies.dedup(empty).collect() == [] and near_copies.keep_one(empty).collect() == []
