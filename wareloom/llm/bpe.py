"""Byte-pair encoding as finite-state machinery.

A sequence of tokens is the encoding of its text exactly if each token encodes to itself and each neighbouring pair
encodes to itself. So the encoding of every prefix has one last token, that token depends on the last tokens of
earlier prefixes within the longest token's reach only, and the encoder is a finite-state device. ``Pairs`` answers
whether two tokens may be neighbours; ``Transducer`` compiles, as its input asks for them, deterministic states
whose transitions carry the change in the number of emitted tokens.
"""

from __future__ import annotations

#: Pairs and words are kept up to KEEP, compiled states up to STATES; beyond it they are forgotten and compiled again.
KEEP, STATES = 400_000, 400_000
SYMBOLS = 0x110000


class Pairs:
    """Merge rules and the neighbourhood relation they imply. rank(a, b) is None if a and b do not merge."""

    def __init__(self, tokens, rank):
        self.rank = rank
        #: each string to itself, so that the states share one copy
        self.tokens = {t: t for t in tokens}
        self.prefixes = {t[:i]: t[:i] for t in tokens for i in range(1, len(t))}
        self.alone: dict[str, bool] = {}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self.known: dict[tuple[str, str], bool] = {}

    def merge(self, symbols: list[str], least: int = 1) -> list[str]:
        """The encoding by its definition: merge the best-ranked pair, leftmost first, while there is one."""
        parts, rank = symbols, self.rank
        while len(parts) > least:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts = parts[:at] + [parts[at] + parts[at + 1]] + parts[at + 2 :]
        return parts

    def split(self, token: str) -> tuple[str, str] | None:
        """The two parts of a token's last merge; None for a symbol, and for what never becomes one token."""
        if token in self.parts:
            return self.parts[token]
        parts, found = list(token), None
        if token in self.tokens and len(token) > 1:
            parts = self.merge(parts, 2)
            if len(parts) == 2 and self.rank(*parts) is not None:
                found = parts[0], parts[1]
        self.parts[token] = found
        return found

    def usable(self, token: str) -> bool:
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = token in self.tokens and (len(token) == 1 or self.split(token) is not None)
        return found

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The parts that form a token's left (0) or right (1) edge, smallest first, each with the rank that ends it."""
        found = self.edges[side].get(token)
        if found is None:
            two = self.split(token)
            if two is None:
                found = [(token, float("inf"))]
            else:
                inner = self.edge(two[side], side)
                found = [*inner[:-1], (inner[-1][0], self.rank(*two)), (token, float("inf"))]
            self.edges[side][token] = found
        return found

    def valid(self, a: str, b: str) -> bool:
        """Whether a and b stay apart: at no time do the parts that meet between them merge before their own tokens grow."""
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) > KEEP:
                self.known.clear()
            left, right, i, j, found = self.edge(a, 1), self.edge(b, 0), 0, 0, True
            while True:
                (x, x_end), (y, y_end) = left[i], right[j]
                r = self.rank(x, y)
                if r is not None and r < x_end and r <= y_end:  # of equal ranks the leftmost goes first
                    found = False
                    break
                if i == len(left) - 1 and j == len(right) - 1:
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            self.known[a, b] = found
        return found


class Recent(dict):
    """A dictionary of two generations: what was not asked for while KEEP others came is forgotten."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        if len(self) >= KEEP:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Transducer:
    """Lazily compiled deterministic transducer from symbols to changes of the token count.

    A state holds, for each suffix of the input read that a longer token may still start with, the last token of what
    precedes that suffix and how many tokens fewer that had. The empty suffix comes first.
    """

    def __init__(self, pairs: Pairs):
        self.pairs = pairs
        self.forget()

    def forget(self) -> None:
        start = (("", None, 0),)
        #: of each state: its rows, its last token; arcs: state * SYMBOLS + symbol -> next state * 2048 + change + 1024
        self.states, self.last, self.arcs = [start], [None], {}
        self.index = {start: 0}

    def arc(self, state: int, symbol: int) -> int:
        pairs, rows, delta, last = self.pairs, [], 0, None
        tokens, prefixes, c = pairs.tokens, pairs.prefixes, chr(symbol)
        for suffix, before, fewer in self.states[state]:
            grown = suffix + c
            if last is None and grown in tokens and pairs.usable(grown) and (before is None or pairs.valid(before, grown)):
                last, delta = tokens[grown], 1 - fewer
            known = prefixes.get(grown)
            if known is not None:
                rows.append((known, before, fewer))
        if last is None:
            raise ValueError(f"no token for {c!r}")
        if not -1024 <= delta < 1024:
            raise ValueError("a token is longer than a thousand symbols")
        if delta:
            key = (("", last, 0), *[(s, b, f + delta) for s, b, f in rows])
        else:
            key = (("", last, 0), *rows)
        new = self.index.get(key)
        if new is None:
            new = self.index[key] = len(self.states)
            self.states.append(key)
            self.last.append(last)
        found = self.arcs[state * SYMBOLS + symbol] = new * 2048 + delta + 1024
        return found

    def count(self, symbols: str) -> int:
        """Tokens of the encoding: the sum along the path from the start state."""
        if len(self.states) > STATES:
            self.forget()
        state, total, arcs = 0, 0, self.arcs
        for c in map(ord, symbols):
            found = arcs.get(state * SYMBOLS + c)
            if found is None:
                found = self.arc(state, c)
            state = found >> 11
            total += (found & 2047) - 1024
        return total

    def path(self, symbols: str) -> list[str]:
        """The encoding: the tokens back along the path."""
        if len(self.states) > STATES:
            self.forget()
        state, lasts, arcs, last = 0, [], self.arcs, self.last
        for c in map(ord, symbols):
            found = arcs.get(state * SYMBOLS + c)
            if found is None:
                found = self.arc(state, c)
            state = found >> 11
            lasts.append(last[state])
        out, at = [], len(lasts)
        while at:
            token = lasts[at - 1]
            out.append(token)
            at -= len(token)
        return out[::-1]
