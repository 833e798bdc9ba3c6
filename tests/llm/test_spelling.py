"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import pytest

from wareloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string"


def near_pairs(words):
    """All pairs one edit apart, by patterns with one place left out."""
    pairs, holes = set(), {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
            short = w[:i] + w[i + 1 :]
            if short in words:
                pairs |= {(w, short), (short, w)}
    for group in holes.values():
        pairs |= {(a, b) for a in group for b in group if a != b}
    return pairs


def plain(rows, length=7):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2 and len(w) >= length}
    near = {}
    for a, b in near_pairs(set(n)):
        near.setdefault(a, []).append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o))
        if n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near.get(w, [])), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def cases():
    rng, rows = random.Random(9), []
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(6, 11))) for _ in range(60)]
    for i in range(300):
        own = []
        for _ in range(40):
            w = stems[int(rng.paretovariate(0.7)) % len(stems)]
            if rng.random() < .3:
                at, c = rng.randrange(len(w) + 1), rng.choice("abcéÿ÷")
                w = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            own.append(rng.choice([w, w.upper(), w.title()]))
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(own), None, "x"))
    rows += [(None, "Without Identity without identity", None, None), (400, None, None, None), (401, "", None, None), (401, "again and again " * 50, None, None)]
    rows += [(402, ("ab" * 5000 + " ") * 2 + ("ab" * 4000 + "x" + "ab" * 1000 + " ") * 30, None, None), (403, ("z" * 300 + " ") * 3 + ("z" * 301 + " ") * 3 + ("z" * 300 + "y ") * 2, None, None)]
    # Forms that lead on: 2 -> 30 -> 400.
    rows += [(404, "leadingx " * 3 + "leadingxy " * 2 + "leadings " * 3 + " leading " * 40 + "eading " * 500, None, None)]
    rows += [(405, "aaaaaaaa aaaaaaaaa aaaaaaa baaaaaaa " * 4, None, None)] * 3
    return rows


@pytest.mark.parametrize("limit", [20_000, 3])
def test_variants_equal_plain(spark, limit):
    """Also where nearly every partition is above the limit and is cut down to single places."""
    rows = cases()
    for some in (rows, rows[:0], rows[-1:]) if limit > 3 else (rows,):
        docs = spark.createDataFrame(some, SCHEMA)
        assert sorted(map(tuple, spelling.variants(docs, limit).collect()), key=str) == plain(some)


def test_forms_lead_on(spark):
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(cases(), SCHEMA)).collect()}
    chains = [w for w, r in found.items() if r.form and r.root != r.form]
    assert chains and all(found[w].root == found[found[w].form].root for w in chains)


@pytest.mark.parametrize("seed", range(6))
def test_acceptors_find_all_pairs(seed):
    rng = random.Random(seed)
    alphabet, size = "ab" if seed < 3 else "abcdé", rng.randrange(1, 7)
    short = sorted({"".join(rng.choice(alphabet) for _ in range(size)) for _ in range(40)})
    long = sorted({"".join(rng.choice(alphabet) for _ in range(size + 1)) for _ in range(40)})
    machine = spelling.Acceptors()
    a, b = machine.build(short), machine.build(long)
    assert sorted(machine.language(a)) == short and sorted(machine.language(b)) == long
    got = [*machine.replaced(a), *machine.inserted(a, b, True)]
    pairs = {(x, y) for x, y in near_pairs({*short, *long}) if len(x) < len(y) or len(x) == len(y) == size and x < y}
    assert len(got) == len(set(got)) and set(got) == pairs
    assert machine.build(short) == a  # equal languages are one state


def test_minimised():
    """All words over two letters: one state a length."""
    machine = spelling.Acceptors()
    words = [f"{i:010b}".translate({48: "a", 49: "b"}) for i in range(1024)]
    machine.build(words)
    assert len(machine.arcs) == 11
