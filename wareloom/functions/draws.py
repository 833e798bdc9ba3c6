"""Stateless random draws as plain column expressions.

A draw is a pure function of (seed, table, column, row key). It needs no
generator state, so a row has the same values under any partitioning, retry or
cluster size, filters move through it, unused columns are pruned, and any other
table can recompute an attribute from its key instead of joining for it.

The hash runs two 32-bit lanes in bigint arithmetic. A round is "xor a constant,
multiply by an odd 31-bit constant, keep the middle 32 bits of the product". No
product exceeds 63 bits, so it also runs with ANSI overflow checks; its input occurs
once, so expressions grow linearly; and it stays inside whole-stage code generation
at a fraction of the cost of a digest function.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW32 = 0xFFFFFFFF
SPAN = 1 << 52  # draws lie in [0, SPAN)
# Fixed value: prime stride that scatters skew ranks over the key space.
STRIDE = 2654435761


def word(*parts) -> int:
    """32-bit constant for a tuple of names, computed once on the driver."""
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def constant_draw(seed: int, *parts) -> int:
    """A 52-bit draw that belongs to a name, not to a row."""
    return int(hashlib.md5("|".join(str(p) for p in (seed, *parts)).encode()).hexdigest()[:13], 16)


def multiplier(*parts) -> int:
    """Odd 31-bit constant for a tuple of names."""
    return (word(*parts, "multiplier") & 0x3FFFFFFF) | 0x40000001


def _round(x: str, *parts) -> str:
    return f"(shiftright(({x} ^ {word(*parts)}L) * {multiplier(*parts)}L, 16) & {LOW32}L)"


def _state_text(seed: int, table: str, key: str, sub: str | None) -> list[str]:
    """SQL text of the two state columns. Text keeps the build at one call per column."""
    key = f"cast({key} AS bigint)"
    out = []
    for lane in (1, 2):
        x = _round(f"({key} & {LOW32}L)", seed, table, lane, 0)
        x = _round(f"({x} ^ (shiftright({key}, 32) & {LOW32}L))", seed, table, lane, 1)
        if sub is not None:
            x = _round(f"({x} ^ (cast({sub} AS bigint) & {LOW32}L))", seed, table, lane, "sub")
        for r in (2, 3):
            x = _round(x, seed, table, lane, r)
        out.append(x)
    return out


def _lanes_text(a: str, b: str) -> str:
    return f"(shiftleft({a}, 20) | shiftright({b}, 12))"


def key_draw(seed: int, name: str, key: str, sub: str | None = None) -> Column:
    """One 52-bit draw straight from a key (SQL text), for use without state columns."""
    return F.expr(_lanes_text(*_state_text(seed, name, f"({key})", sub)))


class Draws:
    """Draws of one table, reading the state columns ``<prefix>1`` and ``<prefix>2``."""

    def __init__(self, seed: int, table: str, prefix: str = "_s"):
        self.seed, self.table, self.prefix = seed, table, prefix

    def attach(self, df: DataFrame, key: str, sub: str | None = None) -> DataFrame:
        """Add the state columns, so that every draw of the row shares them.

        ``key`` is SQL text; ``sub`` separates copies of one key.
        """
        s1, s2 = _state_text(self.seed, self.table, key, sub)
        return df.withColumns({f"{self.prefix}1": F.expr(s1), f"{self.prefix}2": F.expr(s2)})

    def bits(self, name: str) -> Column:
        """Uniform integer in [0, 2**52)."""
        return F.expr(self.bits_text(name))

    def bits_text(self, name: str) -> str:
        lanes = []
        for lane in (1, 2):
            x = f"{self.prefix}{lane}"
            for r in (0, 1):
                x = _round(x, self.seed, self.table, name, lane, r)
            lanes.append(x)
        return _lanes_text(*lanes)

    def index(self, name: str, n: int) -> Column:
        """Uniform integer in [0, n), typed as never NULL (a bare remainder is not)."""
        return F.expr(f"coalesce({self.bits_text(name)} % {int(n)}L, 0L)")

    def randint(self, name: str, low: int, high: int) -> Column:
        """Uniform bigint in [low, high], both included."""
        return F.lit(low) + self.index(name, high - low + 1)

    def choice(self, name: str, values: Sequence) -> Column:
        return pick(values, self.index(name, len(values)))

    def weighted(self, name: str, weights: dict) -> Column:
        """Choice by whole percent weights that sum to 100."""
        if sum(weights.values()) != 100:
            raise ValueError(f"weights of {name} must sum to 100")
        h, bound, out = self.index(name, 100), 0, None
        items = list(weights.items())
        for value, weight in items[:-1]:
            bound += weight
            branch = h < F.lit(bound)
            out = F.when(branch, F.lit(value)) if out is None else out.when(branch, F.lit(value))
        return out.otherwise(F.lit(items[-1][0]))

    def chance(self, name: str, p: float) -> Column:
        """True with probability p."""
        return self.bits(name) < F.lit(threshold(p))

    def date_between(self, name: str, start: date, end: date) -> Column:
        """Uniform date, both ends included; the start when the range is empty."""
        span = max((end - start).days, 0)
        return F.date_add(F.lit(start), self.index(name, span + 1).cast("int"))

    def skewed_key(self, name: str, n: int) -> Column:
        """Key in 1..n where a fifth of the keys receives four fifths of the draws.

        The low digits of one draw choose the hot or cold set, the rest a rank in
        it; a prime stride then scatters the ranks over the key space.
        """
        top = max(1, n // 5)
        h = self.bits(name)
        rank = div(h, 100)
        if n > top:
            rank = F.when(h % F.lit(100) < F.lit(80), rank % F.lit(top)).otherwise(
                F.lit(top) + rank % F.lit(n - top)
            )
        else:
            rank = rank % F.lit(top)
        offset = constant_draw(self.seed, self.table, name, "offset") % n
        return F.lit(1) + F.coalesce((F.lit(STRIDE % n) * rank + F.lit(offset)) % F.lit(n), F.lit(0).cast("bigint"))


def threshold(p: float) -> int:
    """Integer bound b with P(draw < b) = p."""
    return int(p * SPAN)


def pick(values: Sequence, index: Column) -> Column:
    """The zero-based ``index``-th element of a literal list."""
    items = ", ".join("'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v) for v in values)
    return F.element_at(F.expr(f"array({items})"), (index + F.lit(1)).cast("int"))


def div(value: Column, by) -> Column:
    """Integer division of non-negative values."""
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(int(by)))


def money(cents: Column) -> Column:
    """Integer cents as DECIMAL(18,2)."""
    return (cents / F.lit(100.0)).cast("decimal(18,2)")


def share(amount: Column, basis_points: Column) -> Column:
    """Half-up product of a non-negative integer amount and a ratio in 1/10000."""
    return div(amount * basis_points + F.lit(5000), 10000)


def padded_id(prefix: str, key: Column, width: int) -> Column:
    """``PREFIX-000123``; longer keys keep all their digits."""
    text = key.cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")))


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))


def growth_count(base: int | Column, rate: float, months: Column) -> Column:
    """Volume after compound monthly growth, rounded down."""
    base = base if isinstance(base, Column) else F.lit(base)
    return F.floor(base.cast("double") * F.power(F.lit(1.0 + rate), months.cast("double"))).cast("bigint")


def distinct_pair(first: Column, second: Column, n: int) -> tuple[Column, Column]:
    """Two different indexes below n from draws on [0, n) and [0, n-1)."""
    return first, (first + F.lit(1) + second) % F.lit(n)


def month_span(start: date, end: date) -> int:
    return (end.year - start.year) * 12 + end.month - start.month + 1


def growth_day_index(u: Column, day_draw: Column, start: date, end: date, rate: float) -> Column:
    """Zero-based day whose month follows the compound growth curve.

    ``u`` is uniform in [0, 1); the month comes from the inverse of the geometric
    distribution, the day is uniform among the days of that month that lie in the
    window (the first and last month may be partial).
    """
    months = month_span(start, end)
    base = 1.0 + rate
    m = F.floor(F.log(F.lit(1.0) + u * F.lit(base**months - 1.0)) / F.log(F.lit(base))).cast("int")
    m = F.least(F.greatest(m, F.lit(0)), F.lit(months - 1))
    first = F.add_months(F.lit(start.replace(day=1)), m)
    low = F.greatest(first, F.lit(start))
    high = F.least(F.last_day(first), F.lit(end))
    length = (F.date_diff(high, low) + F.lit(1)).cast("bigint")
    return F.date_diff(low, F.lit(start)).cast("bigint") + day_draw % length
