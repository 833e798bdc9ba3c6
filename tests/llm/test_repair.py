"""Conversation repair against plain versions: all edit scripts of short conversations, and a plain dynamic program."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from wareloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cid string, audit string"
OPEN = re.compile("s?(ua)+")


def plan(rows):
    """Least (cost, edits) of rows (initial, must go, cut): states hold the least pair each."""
    best = {"": (0, "")}

    def put(new, state, cost, edits):
        if state not in new or (cost, edits) < new[state]:
            new[state] = (cost, edits)

    def inserted(states):
        for _ in range(2):
            for state, (cost, edits) in list(states.items()):
                put(states, "a" if state == "u" else "u", cost + 2, edits + "I")
        return states

    best = inserted(best)
    for initial, must, cut in rows:
        new = {}
        for state, (cost, edits) in best.items():
            put(new, state, cost + 3, edits + "D")
            if must:
                continue
            follow = "a" if state == "u" else "u"
            put(new, follow, cost + 2 + cut, edits + "R")
            if initial == follow or initial == "s" and state == "":
                put(new, initial, cost + cut, edits + "K")
        best = inserted(new)
    return min(best[s] for s in ("", "a") if s in best)


def plain(rows):
    spaced = lambda x: " " if x is None else str(x)
    conv = {}
    for i, turn, role, text, *_ in rows:
        own = conv.setdefault(i, [])
        role, text, fate = spaced(role), spaced(text), zlib.crc32(f"{spaced(i)}:{spaced(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for i, own in conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            inner = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plan([(a, f in ("blank", "duplicate"), f == "truncated") for a, f in zip(initials, faults)]) if own else (0, "")
        kept, at, roles = [], iter(own), ""
        for edit in audit:
            _, role, text = next(at) if edit != "I" else (0, "", "")
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if roles[-1:] == "u" else "user"
            roles += role[0]
            kept.append(f"{role}:{text}")
        assert not roles or OPEN.fullmatch(roles)
        count = lambda f: faults.count(f)
        out.append((i, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def dropped_key():
    """A (conv_id, turn) whose row the damage drops."""
    return next((i, 0) for i in itertools.count(5000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)


def cases():
    rng, rows = random.Random(5), []
    texts = ["All well.", "cut off", "", " \t", "Yes!", "No?", "é ü。", "a.b ", None]
    for c in range(150):
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t * rng.choice((1, 1, 2)), rng.choice(["system", "user", "assistant", "tool", "User", "", None, "s", "agent"]), rng.choice(texts) if rng.random() < .6 else f"Text {c} {t}.", None, "x"))
    rows += [(200, None, "user", "No turn."), (200, None, "assistant", "None here."), (200, 5, "user", "Five."), (None, None, None, None), (None, 2, "user", "Hm.")]
    rows += [(201, 1, "user", "Again.")] * 40 + [(201, t, "user", "Again.") for t in range(2, 30)]
    rows += [(202, 3, "assistant", "One."), (202, 3, "user", "Two."), (202, 3, "user", "Three.")]
    rows += [(203, 0, "user", "Long. " * 100_000), (203, 1, "assistant", "Long. " * 100_000), (204, 2**62, "user", "Far."), (204, -(2**62), "user", "Near.")]
    rows += [(*dropped_key(), "user", "Gone.")]
    rows += [(300, t, ("user", "assistant")[t % 2] if t % 11 else "system", f"Row {t}" + ".." * (t % 5 > 0)) for t in range(2000)]
    return [(*r, None, None)[:6] for r in rows]


def test_repair_equals_plain(spark):
    rows = cases()
    for some in (rows, rows[::-1], rows[:0], rows[:1]):
        got = repair.repair(spark.createDataFrame(some, SCHEMA))
        assert sorted(map(tuple, got.collect()), key=str) == plain(some)


@pytest.mark.parametrize("length", [1, 3, 50])
def test_segments_of_any_length_agree(spark, length):
    """Conversations cut into many segments, and over many partitions, are pieced together exactly."""
    rows = cases()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        damaged = repair.damaged(spark.createDataFrame(rows, SCHEMA))
        got = {r.cid: tuple(r)[1:] for r in repair.audits(repair.segments(repair.faults(damaged), length)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {repair.NULL_ID if r[0] is None else r[0]: r[1:-1] for r in plain(rows) if r[0] != dropped_key()[0]}
    assert got == want


def test_repaired_rows_fit_the_pattern(spark):
    got = {}
    for r in repair.repaired(spark.createDataFrame(cases(), SCHEMA)).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append(r)
    for rows in got.values():
        assert [r.place for r in rows] == list(range(len(rows)))
        assert OPEN.fullmatch("".join(r.role[0] for r in rows))


def scripts(symbols, state=0, depth=2):
    """(cost, edits) of every edit script with at most depth insertions in a row."""
    if not symbols:
        if state in repair.ACCEPTING:
            yield 0, ""
    else:
        s, rest = symbols[0], symbols[1:]
        role, cut = divmod(s - 1, 2)
        for cost, edits in scripts(rest, state):
            yield cost + 3, "D" + edits
        if s:
            kept = repair.kept_state(state, role)
            if kept is not None:
                yield from ((cost + cut, "K" + edits) for cost, edits in scripts(rest, kept))
            yield from ((cost + cut + 2, "R" + edits) for cost, edits in scripts(rest, repair.NEXT[state]))
    if depth:
        yield from ((cost + 2, "I" + edits) for cost, edits in scripts(symbols, repair.NEXT[state], depth - 1))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_tables_against_all_scripts(n):
    for symbols in itertools.product(range(repair.SYMBOLS), repeat=n):
        if n == 3 and hash(symbols) % 7:
            continue
        machine = repair.tables()
        front, paid = machine.map(machine.cut(bytes(symbols), {}))
        cost = int(paid[machine.end]) + machine.vectors[front[machine.end]][0]
        edits, state = machine.trace(bytes(symbols), {}, machine.end)[0]
        assert (cost, edits + machine.tail(state)) == min(scripts(symbols))


def test_block_lengths_agree():
    rng = random.Random(3)
    for _ in range(50):
        symbols = bytes(rng.randrange(repair.SYMBOLS) for _ in range(rng.randrange(60)))
        extra = {i: rng.randrange(1, 4) for i in range(len(symbols)) if rng.random() < .1}
        found = []
        for block in (1, 2, 3, 4):
            machine = repair.Tables(block)
            front, paid = machine.map(machine.cut(symbols, extra))
            found.append((machine.vectors[front[0]], int(paid[0]), machine.trace(symbols, extra, 0)))
        assert all(f == found[0] for f in found)
    assert max(map(max, repair.tables().vectors)) <= 5  # a state can follow another's plan at 5 more
