"""Conversation structure repair by Four-Russians block tables.

A conversation's rows, in order of turn, are edited at least cost until the initials of their roles read ``(s?(ua)+)?``:
Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant row) 2, and each truncated row that is
not deleted adds 1; blank and duplicate rows must go. The pattern is a machine of four states, so what is still to be
paid from a place on is a vector of four costs. Less its least entry it is one of few vectors, as any state can follow
another state's plan at 5 more. ``Tables`` lists them and, for every block of up to ``BLOCK`` row symbols, the vector in front of the
block for each vector behind it. Blocks are processed from the last to the first by lookup. For the edits, a block is expanded backward
from the vector behind it, and read forward: of the letters that keep to the least cost the ASCII-least is taken, so ties are settled
exactly.

In Spark: rows are damaged by SQL expressions; slim rows (no texts) are counted by equality, duplicates found by ``first_seen``, and the
rest is range-partitioned by conversation and turn and cut into segments of ``SEGMENT`` rows at most. A segment is a map on vectors, so
conversations of any length are pieced together from one small row a segment (backward for the vectors, forward for the states)
while the edits of all segments are traced in parallel. Texts are shuffled once, by conversation, and streamed past the edits into the
digest, which SHA-256 allows in this order only.

Order: by turn, nulls first, then by role and by the MD5 of the text. A turn of -2^63 counts as null.

Edge cases: a null role or text is one space, a null id or turn stands as one space in the hashed string; rows with a null conv_id form
one conversation; repeated rows are duplicates; conversations without rows after the damage get zeros, no edits and the
digest of nothing; gaps stop at 2^63-1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, col, ship, trim, written
from .first_seen import later

WHITE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant. Where an inserted or reroled row leads:
NEXT = (2, 2, 3, 2)
ACCEPTING = (0, 3)
#: Row symbols: 0 must be deleted, else 1 + role (system, user, assistant, other) * 2 + truncated.
MUST_GO, SYMBOLS = 0, 9
SYSTEM, USER, ASSISTANT, OTHER = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
BLOCK = 4
SEGMENT = 4096
LEGAL = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def kept_state(state: int, role: int) -> int | None:
    """Where a row of that role leads if it is kept."""
    if role == SYSTEM:
        return 1 if state == 0 else None
    if role == USER:
        return 2 if state != 2 else None
    return 3 if role == ASSISTANT and state == 2 else None


def with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs to go where rows may be inserted first; more than two in a row lead back."""
    return tuple(min(c, INSERT + costs[NEXT[q]], 2 * INSERT + costs[NEXT[NEXT[q]]]) for q, c in enumerate(costs))


def before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go in front of a row, from those behind it."""
    costs = []
    for q in range(4):
        best = DELETE + after[q]
        if symbol != MUST_GO:
            role, cut = divmod(symbol - 1, 2)
            best = min(best, REROLE + cut + after[NEXT[q]])
            kept = kept_state(q, role)
            if kept is not None:
                best = min(best, KEEP + cut + after[kept])
        costs.append(best)
    return with_inserts(costs)


END = with_inserts([0 if q in ACCEPTING else 99 for q in range(4)])


class Tables:
    """Normalised vectors and the transitions of all blocks."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        first = self.normal(END)[0]
        self.vectors, self.index = [first], {first: 0}
        one = []
        for v in self.vectors:  # grows
            row = []
            for s in range(SYMBOLS):
                new, off = self.normal(before(s, v))
                if new not in self.index:
                    self.index[new] = len(self.vectors)
                    self.vectors.append(new)
                row.append((self.index[new], off))
            one.append(row)
        step = np.array(one, np.int64).transpose(2, 1, 0)  # (vector, offset) by symbol, vector
        #: by length, block (its first symbol leads) and vector behind it: vector in front, cost less that vector's
        self.next, self.cost = [np.arange(len(self.vectors))[None]], [np.zeros((1, len(self.vectors)), np.int64)]
        for _ in range(block):
            inner, paid = self.next[-1], self.cost[-1]
            self.next.append(step[0][:, inner].reshape(-1, len(self.vectors)))
            self.cost.append((step[1][:, inner] + paid[None]).reshape(-1, len(self.vectors)))
        self.traces: dict[tuple, list[tuple[str, int]]] = {}

    @staticmethod
    def normal(v: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        return tuple(c - min(v) for c in v), min(v)

    @property
    def end(self) -> int:
        return 0  # END has least entry 0

    def cut(self, symbols: bytes, extra: dict[int, int]) -> list[bytes]:
        """Blocks of a segment; a row that is followed by further deletions ends its block."""
        out, at = [], 0
        for stop in [*(i + 1 for i in sorted(extra)), len(symbols)]:
            out += [symbols[i : min(i + self.block, stop)] for i in range(at, stop, self.block)]
            at = stop
        return out

    @staticmethod
    def code(block: bytes) -> int:
        n = 0
        for s in block:
            n = n * SYMBOLS + s
        return n

    def map(self, blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(vector in front, cost) of blocks for every vector behind them."""
        at, paid = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for b in reversed(blocks):
            c, n = self.code(b), len(b)
            paid = paid + self.cost[n][c][at]
            at = self.next[n][c][at]
        return at, paid

    def expanded(self, block: bytes, behind: int) -> list[tuple[str, int]]:
        """By state in front: the ASCII-least of the cheapest edits of a block, and the state behind it."""
        found = self.traces.get((block, behind))
        if found is None:
            to_go = [self.vectors[behind]]
            for s in reversed(block):
                to_go.append(before(s, to_go[-1]))
            to_go.reverse()
            found = []
            for q in range(4):
                edits = []
                for i, s in enumerate(block):
                    role, cut = divmod(s - 1, 2)
                    while True:
                        left, here = to_go[i + 1], to_go[i][q]
                        if DELETE + left[q] == here:
                            edits.append("D")
                            break
                        if INSERT + to_go[i][NEXT[q]] == here:
                            edits.append("I")
                            q = NEXT[q]
                            continue
                        kept = kept_state(q, role)
                        if kept is not None and KEEP + cut + left[kept] == here:
                            edits.append("K")
                            q = kept
                        else:
                            edits.append("R")
                            q = NEXT[q]
                        break
                found.append(("".join(edits), q))
            self.traces[block, behind] = found
        return found

    def trace(self, symbols: bytes, extra: dict[int, int], behind: int) -> list[tuple[str, int]]:
        """By state in front of a segment: its edits and the state behind it."""
        blocks, vectors = self.cut(symbols, extra), [behind]
        for b in reversed(blocks):
            vectors.append(int(self.next[len(b)][self.code(b), vectors[-1]]))
        vectors.pop()
        out = []
        for q in range(4):
            edits, done = [], 0
            for b, v in zip(blocks, reversed(vectors)):
                own, q = self.expanded(b, v)[q]
                edits.append(own)
                done += len(b)
                if done - 1 in extra:
                    edits.append("D" * extra[done - 1])
            out.append(("".join(edits), q))
        return out

    @staticmethod
    def tail(state: int) -> str:
        """Insertions behind the last row."""
        return {0: "", 1: "II", 2: "I", 3: ""}[state]


_tables: list[Tables] = []


def tables() -> Tables:
    if not _tables:
        _tables.append(Tables())
    return _tables[0]


def damaged(conversations: DataFrame) -> DataFrame:
    """cid, turn, t, role, text, copies: every row after the damage; copies 0 for a dropped one, 2 for a repeated one."""
    spaced = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "utf-8")) % 20
    turn = F.nullif(col("turn").cast("long"), F.lit(NULL_ID))
    text = spaced("text")
    return conversations.select(
        F.coalesce(col("conv_id").cast("long"), F.lit(NULL_ID)).alias("cid"), turn.alias("turn"),
        F.coalesce(turn, F.lit(NULL_ID)).alias("t"),
        F.when(fate == 4, "user").otherwise(spaced("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """cid, t, role, digest, kind, blank, cut, c, dup: equal rows counted; dup if role and text stand at an earlier turn."""
    inner = F.btrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    slim = written(rows.where("copies > 0").groupBy(
        "cid", "t", "role", F.unhex(F.md5(F.encode("text", "utf-8"))).alias("digest"), kind.cast("long").alias("kind"),
        (inner == "").cast("long").alias("blank"), (~F.substring(inner, -1, 1).isin(".", "!", "?")).cast("long").alias("cut"),
    ).agg(F.sum("copies").alias("c")), "repair-rows")
    keyed = slim.select(F.xxhash64("cid", "role", "digest").alias("h"), F.hash("cid", "role", "digest").cast("long").alias("g"), "t")
    again = later(keyed, ["h", "g"], "t", "repair-later").withColumn("dup", F.lit(1).cast("long"))
    tagged = slim.withColumns({"h": F.xxhash64("cid", "role", "digest"), "g": F.hash("cid", "role", "digest").cast("long")})
    return tagged.join(again, ["h", "g", "t"], "left").drop("h", "g").fillna(0, ["dup"])


SEGMENTS = ("cid long, part int, seq long, symbols binary, extra_at array<int>, extra array<long>, next array<int>, paid array<long>, "
            "blank long, duplicate long, truncated long, illegal long, first int, last int, low long, high long, turns long")


class Segment:
    """Rows of one conversation as they come, up to SEGMENT."""

    def __init__(self, cid: int):
        self.cid, self.symbols, self.extra = cid, bytearray(), {}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.low = self.high = NULL_ID  # no turn yet

    def add(self, t: int, kind: int, blank: int, cut: int, c: int, dup: int) -> None:
        if self.first is None:
            self.first = kind
        elif (self.last, kind) not in LEGAL:
            self.illegal += 1
        self.last = kind
        self.illegal += c - 1
        if blank:
            self.blank += c
        else:
            self.duplicate += c - 1 + dup
            self.truncated += cut if not dup else 0
        if c > 1:
            self.extra[len(self.symbols)] = c - 1
        self.symbols.append(MUST_GO if blank or dup else 1 + kind * 2 + cut)
        if t != NULL_ID:
            if self.low == NULL_ID:
                self.low = t
            if self.high != t:
                self.turns += 1
            self.high = t

    def row(self, part: int, seq: int) -> tuple:
        machine, symbols = tables(), bytes(self.symbols)
        front, paid = machine.map(machine.cut(symbols, self.extra))
        paid = paid + DELETE * sum(self.extra.values())
        return (self.cid, part, seq, symbols, list(self.extra), list(self.extra.values()), front.astype(np.int32), paid, self.blank, self.duplicate,
                self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.turns)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.assign(conv_id=out["conv_id"].astype("Int64")) if "conv_id" in names else out


def segments(rows: DataFrame, length: int = SEGMENT) -> DataFrame:
    """The rows of faults() in order, cut into segments."""
    order = ["cid", "t", "role", "digest"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("part"), "cid", "t", "kind", "blank", "cut", "c", "dup")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seq, part, out = None, 0, 0, []
        for f in frames:
            for part, cid, *row in f.itertuples(index=False, name=None):
                if own is not None and (own.cid != cid or len(own.symbols) >= length):
                    out.append(own.row(part, seq))
                    own, seq = None, seq + 1
                    if len(out) >= 1000:
                        yield _frame(out, SEGMENTS)
                        out = []
                if own is None:
                    own = Segment(cid)
                own.add(*row)
        if own is not None:
            out.append(own.row(part, seq))
        if out:
            yield _frame(out, SEGMENTS)

    return written(placed.mapInPandas(cut, SEGMENTS), "repair-segments")


CONVERSATIONS = "cid long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(cut: DataFrame) -> DataFrame:
    """A row a conversation: its counts, cost and edits."""
    summary = cut.select("cid", "part", "seq", "next", "paid").repartition("cid").sortWithinPartitions(
        "cid", F.desc("part"), F.desc("seq"))

    def backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cid, behind = None, 0
        for f in frames:
            rows = []
            for own, part, seq, front, paid in f.itertuples(index=False, name=None):
                if own != cid:
                    cid, behind = own, tables().end
                rows.append((part, seq, behind, int(paid[behind])))
                behind = int(front[behind])
            yield pd.DataFrame(rows, columns=["part", "seq", "behind", "cost"])

    vectors = summary.mapInPandas(backward, "part int, seq long, behind int, cost long")

    traced = "cid long, part int, seq long, edits array<string>, states array<int>, start int, cost long, " + SEGMENTS[SEGMENTS.index("blank") :]

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = tables()
        for f in frames:
            edits, states, start = [], [], []
            for symbols, at, extra, behind in zip(f["symbols"], f["extra_at"], f["extra"], f["behind"]):
                extra = {int(i): int(n) for i, n in zip(at, extra)}
                found = machine.trace(bytes(symbols), extra, int(behind))
                edits.append([e for e, _ in found])
                states.append([q for _, q in found])
                front = int(machine.map(machine.cut(bytes(symbols), extra))[0][behind])
                start.append(machine.vectors[front][0])
            f = f.assign(edits=edits, states=states, start=start)
            yield f[[c.split()[0] for c in traced.split(", ")]]

    pieces = cut.join(vectors, ["part", "seq"]).mapInPandas(trace, traced).repartition("cid").sortWithinPartitions("cid", "part", "seq")

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, out = None, []

        def done() -> tuple:
            low, high = own["low"], own["high"]
            gaps = min(high - low + 1 - own["turns"], 2**63 - 1) if low != NULL_ID else 0
            audit = "".join(own["edits"]) + Tables.tail(own["state"])
            return (own["cid"], gaps, own["blank"], own["duplicate"], own["truncated"], own["illegal"], own["cost"], audit)

        for f in frames:
            for r in f.itertuples(index=False):
                low, high = int(r.low), int(r.high)
                if own is None or own["cid"] != r.cid:
                    if own is not None:
                        out.append(done())
                        if len(out) >= 1000:
                            yield _frame(out, CONVERSATIONS)
                            out = []
                    # The vector in front of the first segment, at its start state, completes the cost.
                    own = {"cid": r.cid, "edits": [], "state": 0, "cost": int(r.start), "low": NULL_ID, "high": NULL_ID, "last": None,
                           **dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)}
                elif (own["last"], r.first) not in LEGAL:
                    own["illegal"] += 1
                own["last"] = r.last
                own["edits"].append(r.edits[own["state"]])
                own["state"] = int(r.states[own["state"]])
                for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                    own[c] += int(getattr(r, c))
                if low != NULL_ID:
                    if own["low"] == NULL_ID:
                        own["low"] = low
                    elif own["high"] == low:
                        own["turns"] -= 1  # a turn that two segments share
                    own["high"] = high
        if own is not None:
            out.append(done())
        if out:
            yield _frame(out, CONVERSATIONS)
        trim()

    return pieces.mapInPandas(forward, CONVERSATIONS)


class Repaired:
    """A conversation's rows on their way past its edits; pieces() are the parts of the repaired conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.turned(), ""

    def turned(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == 2 else "assistant"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = kept_state(self.state, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]])
            yield role, text
        elif edit == "R":
            yield self.turned(), text


def _streamed(conversations: DataFrame, visit, schema: str) -> DataFrame:
    """visit(conversation's summary or None, rows (role, text)) for each conversation, in order, without holding its texts."""
    ship(conversations.sparkSession)
    rows = damaged(conversations)
    summary = audits(segments(faults(rows)))
    names = [c.split()[0] for c in CONVERSATIONS.split(", ")]
    told = summary.select("cid", F.lit(0).alias("tag"), F.struct(*names[1:]).alias("told"), *[
        F.lit(None).cast(k).alias(c) for c, k in (("t", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"), ("copies", "int"))])
    texts = rows.select(
        "cid", F.lit(1).alias("tag"), F.lit(None).cast(told.schema["told"].dataType).alias("told"), "t", "role",
        F.unhex(F.md5(F.encode("text", "utf-8"))).alias("digest"), F.when(F.col("copies") > 0, F.col("text")).alias("text"), "copies")
    both = told.unionByName(texts).repartition("cid").sortWithinPartitions("cid", "tag", "t", "role", "digest").select(
        "cid", "tag", "told", "role", "text", "copies")
    return both.mapInPandas(lambda frames: visit(frames), schema)


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def _walk(frames: Iterator[pd.DataFrame]):
    """(cid, told or None, None) where a conversation begins, then (cid, told, (role, text)) for its rows after the damage."""
    cid, told = None, None
    for f in frames:
        for own, tag, summary, role, text, copies in f.itertuples(index=False, name=None):
            if own != cid:
                cid, told = own, summary if tag == 0 else None
                yield cid, told, None
            if tag:
                for _ in range(int(copies)):
                    yield cid, told, (role, text)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""

    def visit(frames):
        out, cid, told, path, sha, empty = [], None, None, None, None, True

        def done():
            if path is not None:
                for role, text in path.inserted():
                    sha.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
            own = told or {"audit": "", **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)}
            return (None if cid == NULL_ID else cid, *[own[c.split()[0]] for c in RESULT.split(", ")[1:-1]], sha.hexdigest())

        for own, summary, row in _walk(frames):
            if row is None:
                if sha is not None:
                    out.append(done())
                    if len(out) >= 1000:
                        yield _frame(out, RESULT)
                        out = []
                cid, told, sha, empty = own, summary, hashlib.sha256(), True
                path = Repaired(told["audit"]) if told else None
                continue
            for role, text in path.row(*row):
                sha.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                empty = False
        if sha is not None:
            out.append(done())
        if out:
            yield _frame(out, RESULT)
        trim()

    return _streamed(conversations, visit, RESULT)


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the repaired conversations, row by row."""

    def visit(frames):
        rows, cid, path, place = [], None, None, 0

        def put(parts):
            nonlocal place
            for role, text in parts:
                rows.append((None if cid == NULL_ID else cid, place, role, text))
                place += 1

        for own, summary, row in _walk(frames):
            if row is None:
                if path is not None:
                    put(path.inserted())
                cid, place, path = own, 0, Repaired(summary["audit"]) if summary else None
            else:
                put(path.row(*row))
            if len(rows) >= 1000:
                yield _frame(rows, "conv_id long, place long, role string, text string")
                rows.clear()
        if path is not None:
            put(path.inserted())
        if rows:
            yield _frame(rows, "conv_id long, place long, role string, text string")

    return _streamed(conversations, visit, "conv_id long, place long, role string, text string")
