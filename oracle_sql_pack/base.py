"""Shared text pieces: the draw macro, the window of the data and table CTEs."""

from __future__ import annotations

from wareloom.functions.draws import LOW32, STRIDE, constant_draw, multiplier, threshold, word

SEED = 42


def _round(x: str, *parts) -> str:
    return f"((xor({x}, {word(*parts)}) * {multiplier(*parts)} >> 16) & {LOW32})"


def _states(src: str, table: str, key: str, sub: str | None, seed: int) -> str:
    """The rows of ``src`` with state columns _a and _b of the row key."""
    key = f"({key})::BIGINT"
    lanes = []
    for lane in (1, 2):
        x = _round(f"({key} & {LOW32})", seed, table, lane, 0)
        x = _round(f"xor({x}, ({key} >> 32) & {LOW32})", seed, table, lane, 1)
        if sub is not None:
            x = _round(f"xor({x}, ({sub})::BIGINT & {LOW32})", seed, table, lane, "sub")
        for r in (2, 3):
            x = _round(x, seed, table, lane, r)
        lanes.append(x)
    return f"SELECT *, {lanes[0]} AS _a, {lanes[1]} AS _b FROM ({src})"


def drawn(src: str, table: str, key: str, cols: list[str], sub: str | None = None, prefix: str = "h_", seed: int = SEED) -> str:
    """The rows of ``src`` with one draw column ``h_<col>`` per name; ``key`` is the row key."""
    out = []
    for c in cols:
        a = _round(_round("_a", seed, table, c, 1, 0), seed, table, c, 1, 1)
        b = _round(_round("_b", seed, table, c, 2, 0), seed, table, c, 2, 1)
        out.append(f"(({a} << 20) | ({b} >> 12)) AS {prefix}{c.replace(':', '_').replace(' ', '_')}")
    return f"SELECT * EXCLUDE (_a, _b), {', '.join(out)} FROM ({_states(src, table, key, sub, seed)})"


def key_drawn(src: str, name: str, key: str, out: str, seed: int = SEED) -> str:
    """The rows of ``src`` with one draw taken straight from a key."""
    return f"SELECT * EXCLUDE (_a, _b), ((_a << 20) | (_b >> 12)) AS {out} FROM ({_states(src, name, key, None, seed)})"


def skew(h: str, n: str, table: str, name: str, seed: int = SEED) -> str:
    """Key in 1..n with the hot fifth, from draw column h."""
    top = f"greatest(1, {n} // 5)"
    rank = (f"CASE WHEN {h} % 100 < 80 OR {n} <= {top} THEN ({h} // 100) % {top} "
            f"ELSE {top} + ({h} // 100) % nullif({n} - {top}, 0) END")
    off = constant_draw(seed, table, name, "offset")
    return f"(1 + (({STRIDE} % {n}) * ({rank}) + {off} % {n}) % {n})"


def pick(values, index: str) -> str:
    items = ", ".join(quote(v) for v in values)
    return f"([{items}])[({index}) + 1]"


def quote(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def choice(h: str, values) -> str:
    return pick(values, f"{h} % {len(values)}")


def weighted(h: str, weights: dict) -> str:
    out, bound = "CASE", 0
    items = list(weights.items())
    for value, weight in items[:-1]:
        bound += weight
        out += f" WHEN {h} % 100 < {bound} THEN {quote(value)}"
    return f"({out} ELSE {quote(items[-1][0])} END)"


def chance(h: str, p: float) -> str:
    return f"({h} < {threshold(p)})"


def between(h: str, low: int, high: int) -> str:
    return f"({low} + {h} % {high - low + 1})"


def money(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(20,0)) / 100 AS DECIMAL(18,2))"


def share(amount: str, bp: str) -> str:
    return f"((({amount}) * ({bp}) + 5000) // 10000)"


def day(start: str, end: str, h: str) -> str:
    return f"({start} + CAST({h} % (greatest({end} - {start}, 0) + 1) AS INTEGER))"


def rows(n: str) -> str:
    return f"SELECT unnest(range(({n})::BIGINT)) AS id"


# One row: last day, first day and number of days of the generated window.
WINDOW = """win AS (
  SELECT e, (e - (m * 30)::INTEGER)::DATE AS s, m * 30 + 1 AS d, m
  FROM (SELECT max(o_orderdate)::DATE AS e,
               greatest(1, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) // 30) AS m
        FROM orders))"""
