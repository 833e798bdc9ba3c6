"""Controlled dirtying of tables: text noise, duplicates, wrong values, missing cells.

Every operator decides per cell from a draw keyed by (row key, copy number, operator,
column), so the same cells are hit under any partitioning, and the text operators of
a dimension run in one projection stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareloom.functions.draws import Draws, constant_draw, key_draw, threshold
from wareloom.functions.text import title_text, typo_text
from wareloom.operators.ranking import hash_rank

# Fixed values.
PROTECTED = ("_key", "_id", "date_key")
COUNTRY_SPELLINGS = {
    "USA": ["USA", "US", "United States", "U.S.A.", "U.S.", "America", "usa"],
    "UK": ["UK", "United Kingdom", "Great Britain", "GB", "England"],
    "Canada": ["Canada", "CA", "CAN", "canada"],
}
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "MMMM dd, yyyy"]
NULL_SPELLINGS = {None: 55, "": 20, "N/A": 15, "null": 10}  # two of the five spellings are true nulls
CASE_RATE, TYPO_RATE, SPACE_RATE, COUNTRY_RATE = 0.3, 0.1, 0.15, 0.2
DUPLICATE_RATE, VALUE_RATE = 0.02, 0.03
NULL_RATE = {True: 0.3, False: 0.5}  # dimension, fact
NULL_CAP = 0.2   # default bound of the share of missing cells in a column
RATE_CAP = 0.5   # default bound of the error rate

FEW_PICKS = 262_144  # picks that are broadcast; also the 64-bit words of the filter for more

_COPY = "_copy_no"


def clamp_rate(rate: float, cap: float = RATE_CAP) -> float:
    return min(max(rate, 0.0), cap)


def is_protected(col: str, extra: Iterable[str] = ()) -> bool:
    """Key-like columns are never dirtied; ``extra`` names further ones."""
    return any(p in col.lower() for p in PROTECTED) or col in set(extra)


def landing(df: DataFrame) -> DataFrame:
    """The raw form of a table: dates as ISO text, as files deliver them."""
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df


Edit = Callable[[str, str], str]  # SQL text of the new value from those of value and draw
#: The rows of a table at the positions in ``_pick`` of the given picks, and how many ``_times`` each is asked for; the number of picks.
Lookup = Callable[[DataFrame, int], DataFrame]


def edited(value: str, edits: list[tuple[str, int, Edit]]) -> Column:
    """A cell after its edits.

    Untouched cells, the great majority, only pay for the draws, once each. For the
    others the edits run one after the other on a value and draws that ``transform``
    binds once, so the expression grows with the sum of the edits and not with their
    product, and the generated method stays small enough for the JVM to compile.
    """
    hit_any = " OR ".join(f"{h} < {bound}L" for h, bound, _ in edits)
    only = edits[0][2](value, "h0") if len(edits) == 1 else "h0"
    if "h0" not in only:  # a single edit that does not look at its draw
        return F.expr(f"CASE WHEN {hit_any} THEN {only} ELSE {value} END")
    fields = ", ".join(f"'h{i}', {h}" for i, (h, _, _) in enumerate(edits))
    text = "x.v"
    for i, (_, bound, function) in enumerate(edits):
        step = f"CASE WHEN x.h{i} < {bound}L THEN {function(f'b{i}', f'x.h{i}')} ELSE b{i} END"
        text = bind(text, f"b{i}", step)
    slow = bind(f"named_struct('v', {value}, {fields})", "x", text)
    return F.expr(f"CASE WHEN {hit_any} THEN {slow} ELSE {value} END")


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to the value, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def vary_case(v: str, h: str) -> str:
    return f"CASE {h} % 3 WHEN 0 THEN upper({v}) WHEN 1 THEN lower({v}) ELSE {title_text(v)} END"


def vary_spaces(v: str, h: str) -> str:
    return f"CASE {h} % 3 WHEN 0 THEN concat('  ', {v}) WHEN 1 THEN concat({v}, '  ') ELSE replace({v}, ' ', '  ') END"


def vary_country(v: str, h: str) -> str:
    out = "CASE"
    for spellings in COUNTRY_SPELLINGS.values():
        names = ", ".join(f"'{s}'" for s in spellings)
        out += f" WHEN {v} IN ({names}) THEN element_at(array({names}), cast({h} % {len(spellings)} + 1 AS int))"
    return f"{out} ELSE {v} END"


def spell_null(v: str, h: str) -> str:
    out, bound = "CASE", 0
    for text, weight in NULL_SPELLINGS.items():
        bound += weight
        spelled = "cast(NULL AS string)" if text is None else f"'{text}'"
        out += f" WHEN {h} % 100 < {bound} THEN {spelled}"
    return f"{out} END"


def scale_by(factor: float, t: T.DataType) -> Edit:
    exact = f"cast('{factor}' AS decimal(5,4))" if isinstance(t, T.DecimalType) else f"cast({factor}D AS double)"
    return lambda v, h: f"cast({v} * {exact} AS {t.simpleString()})"


def is_quantity(col: str) -> bool:
    return "quantity" in col.lower() or "qty" in col.lower()


def is_amount(col: str) -> bool:
    return any(w in col.lower() for w in ("amount", "total", "revenue"))


class Noise:
    """Draws for the rows of one table; ``key`` must identify a row together with the copy number."""

    def __init__(self, seed: int, rate: float, key: str, protected: Iterable[str] = (), copy: str | None = None):
        self.u = Draws(seed, "quality", "_q")
        self.seed, self.rate = seed, clamp_rate(rate)
        self.key, self.copy, self.protected = key, copy, tuple(protected)

    def attach(self, df: DataFrame) -> DataFrame:
        return self.u.attach(df, self.key, self.copy)

    @staticmethod
    def detach(df: DataFrame) -> DataFrame:
        return df.drop("_q1", "_q2")

    # One edit of a cell: (draw, hit bound, function of value and draw). The low
    # digits of the draw choose among variants, its size decides whether it hits.

    def _edit(self, name: str, rate: float, function: Edit) -> tuple:
        return self.u.bits_text(name), threshold(rate), function

    def _case(self, df, c):
        if isinstance(df.schema[c].dataType, T.StringType):
            yield self._edit(f"case:{c}", self.rate * CASE_RATE, vary_case)

    def _typo(self, df, c):
        if isinstance(df.schema[c].dataType, T.StringType) and ("name" in c.lower() or "city" in c.lower()):
            yield self._edit(f"typo:{c}", self.rate * TYPO_RATE, typo_text)

    def _space(self, df, c):
        if isinstance(df.schema[c].dataType, T.StringType):
            yield self._edit(f"space:{c}", self.rate * SPACE_RATE, vary_spaces)

    def _country(self, df, c):
        if c == "country":
            yield self._edit("country", self.rate * COUNTRY_RATE, vary_country)

    def _negative(self, df, c):
        if isinstance(df.schema[c].dataType, T.NumericType) and is_quantity(c):
            yield self._edit(f"negative:{c}", self.rate * VALUE_RATE, lambda v, h: f"-abs({v})")

    def _amount(self, df, c):
        t = df.schema[c].dataType
        if isinstance(t, T.NumericType) and not is_quantity(c) and is_amount(c):
            yield self._edit(f"amount:{c}", self.rate * VALUE_RATE, scale_by(amount_factor(self.seed, c), t))

    def _null(self, is_dimension):
        def edits(df, c):
            t = df.schema[c].dataType
            function = spell_null if isinstance(t, T.StringType) else lambda v, h: f"cast(NULL AS {t.simpleString()})"
            yield self._edit(f"null:{c}", null_rate(c, self.rate, is_dimension), function)

        return edits

    def apply(self, df: DataFrame, *kinds) -> DataFrame:
        """All edits of the given kinds, in this order per column, in one projection."""
        out = {}
        for f in df.schema.fields:
            c = f.name
            if c.startswith("_") or is_protected(c, self.protected):
                continue
            edits = [e for kind in kinds for e in kind(df, c)]
            if edits:
                out[c] = edited(f"`{c}`", edits)
        return df.withColumns(out) if out else df

    def case(self, df: DataFrame) -> DataFrame:
        return self.apply(df, self._case)

    def typos(self, df: DataFrame) -> DataFrame:
        return self.apply(df, self._typo)

    def whitespace(self, df: DataFrame) -> DataFrame:
        return self.apply(df, self._space)

    def country(self, df: DataFrame) -> DataFrame:
        return self.apply(df, self._country)

    def negative_quantities(self, df: DataFrame) -> DataFrame:
        return self.apply(df, self._negative)

    def amount_errors(self, df: DataFrame) -> DataFrame:
        """Hit amounts are scaled by one factor in [0.5, 1.5) per column."""
        return self.apply(df, self._amount)

    def nulls(self, df: DataFrame, is_dimension: bool) -> DataFrame:
        """Missing cells: text columns get several spellings, other types SQL NULL."""
        return self.apply(df, self._null(is_dimension))

    def dimension(self, df: DataFrame) -> DataFrame:
        return self.apply(df, self._case, self._typo, self._space, self._country, self._null(True))

    def fact(self, df: DataFrame) -> DataFrame:
        return self.apply(df, self._negative, self._amount, self._null(False))

    def date_formats(self, df: DataFrame, cols: list[str]) -> DataFrame:
        """Rewrite hit ISO dates in one of six formats (not part of ``inject_issues``)."""
        out = {}
        for c in cols:
            h = self.u.bits(f"format:{c}")
            hit = h < F.lit(threshold(self.rate))
            day = F.col(c).try_cast("date")
            text = F.lit(None).cast("string")
            for i, pattern in enumerate(DATE_FORMATS):
                text = F.when(h % F.lit(len(DATE_FORMATS)) == i, F.date_format(day, pattern)).otherwise(text)
            out[c] = F.when(hit & day.isNotNull(), text).otherwise(F.col(c))
        return df.withColumns(out)


def amount_factor(seed: int, col: str) -> float:
    return (5000 + constant_draw(seed, "quality", "amount factor", col) % 10000) / 10000


def null_rate(col: str, rate: float, is_dimension: bool, cap: float = NULL_CAP) -> float:
    name, p = col.lower(), rate * NULL_RATE[is_dimension]
    if any(w in name for w in ("phone", "fax", "middle")):
        p *= 2
    elif any(w in name for w in ("name", "email", "id")):
        p *= 0.3
    return min(p, cap)


def duplicate_count(n_rows: int, rate: float) -> int:
    return int(n_rows * (clamp_rate(rate) * DUPLICATE_RATE))


def edit_rates(table: str, df: DataFrame, rate: float) -> dict[str, float]:
    """Kind of edit -> expected share of the rows or cells that it touches, of the edits that apply to the table."""
    rate = clamp_rate(rate)
    open_ = [f for f in df.schema.fields if not is_protected(f.name)]
    texts = [f.name for f in open_ if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in open_ if isinstance(f.dataType, T.NumericType)]
    dimension = table.startswith("dim_")
    kinds = {}
    if dimension and texts:
        kinds |= {"letter case": rate * CASE_RATE, "typing": rate * TYPO_RATE, "spaces": rate * SPACE_RATE}
        if any("country" in c.lower() for c in texts):
            kinds["country spelling"] = rate * COUNTRY_RATE
    if not dimension:
        kinds["repeated rows"] = rate * DUPLICATE_RATE
        if any(is_quantity(c) for c in numbers):
            kinds["sign of quantities"] = rate * VALUE_RATE
        if any(is_amount(c) for c in numbers):
            kinds["scale of amounts"] = rate * VALUE_RATE
    if open_:
        kinds["missing cells, largest share of a column"] = max(null_rate(f.name, rate, dimension) for f in open_)
    return kinds


def inject_duplicates(
    df: DataFrame, rate: float, seed: int, key: str, n_rows: int, first_key: int = 1, dense: bool = True, rows_at: Lookup | None = None
) -> DataFrame:
    """Append rows drawn with replacement; ``_copy_no`` is 0 for originals, 1, 2, … for copies.

    A dense key (first_key .. first_key + n_rows - 1) is drawn directly. Any other
    unique key is numbered first, in hash order. The drawn keys are counted before
    they meet the table, so both sides of the join have unique keys (see ``_picked``).
    With ``rows_at``, for a dense key, the table itself looks the drawn positions up and is not read for them.
    """
    original = df.withColumn(_COPY, F.lit(0).cast("bigint"))
    k = duplicate_count(n_rows, rate)
    if k == 0:
        return original
    picks = df.sparkSession.range(k).select((key_draw(seed, "quality.duplicates", "id") % F.lit(n_rows)).alias("_pick"))
    drawn = picks.groupBy("_pick").agg(F.count(F.lit(1)).alias("_times"))
    if dense and rows_at is not None:
        found = rows_at(picks, k)
    elif dense:
        found = _picked(df.withColumn("_pick", F.col(key) - F.lit(first_key)), drawn, k)
    else:
        ranked = hash_rank(
            df.withColumn("_order", key_draw(seed, "quality.row order", key)), "_order", [key], n_rows
        )
        found = _picked(ranked.withColumn("_pick", F.col("_rank") - F.lit(1)).drop("_rank", "_order"), drawn, k)
    copies = found.select(
        *df.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))).alias(_COPY)
    )
    return original.unionByName(copies)


def _picked(source: DataFrame, drawn: DataFrame, k: int) -> DataFrame:
    """The rows of ``source`` with a pick among the k drawn ones, beside its ``_times``.

    The planner knows no size of a generated table and may take it for the small side, so the way is fixed here: few picks
    are broadcast; many leave a broadcast bitmap of bounded size, and only rows whose bit is set, of which an exact join
    drops the wrong ones, are shuffled.
    """
    if k <= FEW_PICKS:
        return source.join(F.broadcast(drawn), "_pick")
    word, bit = "pmod(shiftright(_pick, 6), {})".format(FEW_PICKS), "shiftleft(1L, cast(pmod(_pick, 64) AS int))"
    words = drawn.groupBy(F.expr(word).alias("_word")).agg(F.expr(f"bit_or({bit})").alias("_bits"))
    near = source.join(F.broadcast(words), F.expr(f"{word} = _word")).where(F.expr(f"_bits & {bit} != 0")).drop("_word", "_bits")
    return near.join(drawn.hint("merge"), "_pick")


def inject_dimension(df: DataFrame, rate: float, seed: int, key: str, protected: Iterable[str] = ()) -> DataFrame:
    """Case, typos, whitespace, country spellings and missing cells, in this order."""
    if clamp_rate(rate) == 0:
        return df
    noise = Noise(seed, rate, key, protected)
    return noise.detach(noise.dimension(noise.attach(df)))


def inject_fact(
    df: DataFrame, rate: float, seed: int, key: str, n_rows: int,
    protected: Iterable[str] = (), first_key: int = 1, dense: bool = True, keep_copy_no: bool = False, rows_at: Lookup | None = None,
) -> DataFrame:
    """Duplicates, value errors and missing cells, in this order."""
    if clamp_rate(rate) == 0:
        return df
    noise = Noise(seed, rate, key, protected, copy=_COPY)
    df = noise.attach(inject_duplicates(df, rate, seed, key, n_rows, first_key, dense, rows_at))
    df = noise.detach(noise.fact(df))
    return df if keep_copy_no else df.drop(_COPY)


def inject_time_travelers(
    df: DataFrame, start_col: str, end_col: str, key: str, rate: float = 0.02, seed: int = 42
) -> DataFrame:
    """End 1 to 10 days before the start in some rows; rows without a readable start stay."""
    if start_col not in df.columns or end_col not in df.columns:
        return df
    h = key_draw(seed, f"time travel:{start_col}:{end_col}", key)
    start = F.col(start_col).try_cast("date")
    wrong = F.date_sub(start, (h % F.lit(10) + F.lit(1)).cast("int")).cast("string")
    hit = (h < F.lit(threshold(rate))) & start.isNotNull()
    return df.withColumn(end_col, F.when(hit, wrong).otherwise(F.col(end_col)))


def inject_orphans(
    df: DataFrame, fk_col: str, key: str, max_valid: int | None = None, rate: float = 0.02, seed: int = 42
) -> DataFrame:
    """Point some rows to one key beyond ``max_valid`` (by default beyond the column's maximum)."""
    if fk_col not in df.columns:
        return df
    top = F.lit(max_valid) if max_valid is not None else df.agg(F.max(fk_col)).scalar()
    shift = 1000 + constant_draw(seed, "orphan", fk_col) % 9000
    hit = key_draw(seed, f"orphan:{fk_col}", key) < F.lit(threshold(rate))
    t = df.schema[fk_col].dataType
    return df.withColumn(fk_col, F.when(hit, (top + F.lit(shift)).cast(t)).otherwise(F.col(fk_col)))
