"""Cleaning recipe: text, countries, missing values, duplicates, negative quantities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareloom.functions.text import collapsed_text, title_case
from wareloom.operators.quality import COUNTRY_SPELLINGS
from wareloom.operators.ranking import dealt_join, group_quantiles, stepped

# What counts as missing in text, after trimming and upper-casing.
NULL_TEXTS = ["", "N/A", "NULL"]


def clean_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """Trim, collapse repeated spaces and title-case."""
    return df.withColumns({c: title_case(collapsed_text(f"`{c}`")) for c in cols})


def clean_country(df: DataFrame, col: str = "country") -> DataFrame:
    """Map every known spelling to its standard name; other values are only trimmed."""
    value = F.trim(col)
    key, out = F.upper(value), None
    for standard, spellings in COUNTRY_SPELLINGS.items():
        known = sorted({s.upper() for s in spellings})
        out = F.when(key.isin(known), F.lit(standard)) if out is None else out.when(key.isin(known), F.lit(standard))
    return df.withColumn(col, out.otherwise(value))


def is_null_text(c: Column) -> Column:
    return F.upper(F.trim(c)).isin(NULL_TEXTS)


def sentinels_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn spelled-out missing values of text columns into SQL NULL."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~is_null_text(F.col(c)), F.col(c)) for c in cols}) if cols else df


@dataclass(frozen=True)
class By:
    """A statistic ("mean", "median" or "mode") of the rows that agree in some columns."""

    how: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Last:
    """The last known value in the order of some columns, within rows that agree in others."""

    order: tuple[str, ...]
    within: tuple[str, ...] = ()


def _group_fill(df: DataFrame, c: str, how: str, names: list[str], by: tuple[str, ...]) -> DataFrame:
    """(names, _fill): the statistic of each group with a known value; ``names`` stand for the columns ``by``."""
    known = df.where(F.col(c).isNotNull())
    groups = [F.col(b).alias(n) for b, n in zip(by, names)]
    if how == "mean":
        return known.groupBy(*groups).agg((F.sum(F.col(c).cast("decimal(38,6)")).cast("double") / F.count(c)).alias("_fill"))
    if how == "median":
        return group_quantiles(known, c, [0.5], list(by)).select(*groups, F.col("q0").alias("_fill"))
    if how == "mode":
        counts = known.groupBy(*groups, F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        return counts.groupBy(*names).agg(F.min(F.struct((-F.col("_n")).alias("_less"), "_v"))["_v"].alias("_fill"))
    raise ValueError("a group statistic is mean, median or mode")


def fill_by_group(df: DataFrame, c: str, how: str, by: tuple[str, ...], source: DataFrame | None = None) -> DataFrame:
    """Missing cells of a column from the rows of their group in ``source`` (by default the same rows); a group without a known value
    keeps them.

    Groups are summed up before the shuffle; the rows of a large one are dealt over many tasks when they get their value.
    """
    source = df if source is None else source
    names = [f"_b{i}" for i in range(len(by))]
    sizes = source.groupBy(*[F.col(b).alias(n) for b, n in zip(by, names)]).agg(F.count(F.lit(1)).alias("_size"))
    found = _group_fill(source, c, how, [f"_g{i}" for i in range(len(by))], by)
    same = F.lit(True)
    for i, n in enumerate(names):
        same = same & F.col(n).eqNullSafe(F.col(f"_g{i}"))
    lookup = sizes.join(found, same, "left").select(*names, "_size", "_fill")
    filled = dealt_join(df, lookup, list(zip(by, names)), "_size", F.xxhash64(*df.columns))
    return filled.withColumn(c, F.coalesce(F.col(c), F.col("_fill").cast(df.schema[c].dataType))).drop("_fill")


def fill_last_known(df: DataFrame, cols: list[str], order: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """Missing cells of columns from the last known ones before them.

    Rows are cut into steps of even size by their place in the order, so neither one large group nor the whole table is one
    task; each step hands its last known values on, one row a step. Rows at one place of the order must be the same row.
    """
    group = list(within)
    parts = stepped(df.withColumn("_at", F.struct(*order)), group, "_at")
    here = W.partitionBy(*group, "_step").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    names = [f"_w{i}" for i in range(len(group))]
    ends = parts.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names)], F.col("_step").alias("_s")).agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct("_at", F.col(c).alias("_v"))))["_v"].alias(f"_end{i}") for i, c in enumerate(cols)])
    before = W.partitionBy(*names).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*names, "_s", *[F.last(f"_end{i}", ignorenulls=True).over(before).alias(f"_carry{i}") for i in range(len(cols))])
    same = F.col("_step") == F.col("_s")
    for g, n in zip(group, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    joined = parts.withColumns({f"_here{i}": F.last(c, ignorenulls=True).over(here) for i, c in enumerate(cols)}).join(carried, same)
    return joined.withColumns({c: F.coalesce(f"_here{i}", f"_carry{i}") for i, c in enumerate(cols)}).select(*df.columns)


def impute(df: DataFrame, strategies: dict) -> DataFrame:
    """Fill missing cells. A strategy is "mean", "median", "mode", a constant in a one-element tuple, ``By`` or ``Last``.

    Statistics of the whole table are one-row aggregates that the filled projection reads as scalar subqueries; last known values are
    carried along (``Last``) and those of groups are joined (``By``), whose columns are not filled in the same call. Every strategy sees the
    cells as they were, not those that another has filled. Ties of the mode go to the smaller value; a median is the lower of two middle ones.
    """
    df = sentinels_to_null(df, [c for c in strategies if isinstance(df.schema[c].dataType, T.StringType)])
    out = {}
    for c, how in strategies.items():
        t = df.schema[c].dataType
        if isinstance(how, (By, Last)):
            continue
        if how == "mean":
            exact = F.col(c).cast("decimal(38,6)")
            fill = df.agg((F.sum(exact).cast("double") / F.count(c)).alias("m")).scalar()
        elif how == "median":
            fill = group_quantiles(df, c, [0.5], []).select("q0").scalar()
        elif how == "mode":
            counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            fill = counts.orderBy(F.desc("_n"), c).limit(1).select(c).scalar()
        else:
            fill = F.lit(how[0])
        out[c] = F.coalesce(F.col(c), fill.cast(t))
    carried: dict[Last, list[str]] = {}
    for c, how in strategies.items():
        if isinstance(how, Last):
            carried.setdefault(how, []).append(c)
    filled = df
    for how, cols in carried.items():
        filled = fill_last_known(filled, cols, how.order, how.within)
    for c, how in strategies.items():
        if isinstance(how, By):
            if set(how.columns) & set(strategies):
                raise ValueError("a group's columns must not be filled in the same call")
            filled = fill_by_group(filled, c, how.how, how.columns, df)
    return filled.withColumns(out).select(*df.columns) if out else filled.select(*df.columns)


def drop_missing(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows whose critical fields are all present."""
    return sentinels_to_null(df).dropna(subset=required)


def dedupe(df: DataFrame, key: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key: the first or last by ``order``, or the first known value per column.

    Written as min/max of a row struct, which combines before the shuffle: a key
    with very many copies costs one buffer per task instead of one sorted group.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    if keep in ("first", "last"):
        row = F.struct(*order, *rest)
        best = (F.min if keep == "first" else F.max)(row).alias("_row")
        return df.groupBy(*key).agg(best).select(
            *[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns]
        )
    if keep != "merge":
        raise ValueError("keep is first, last or merge")
    values = [c for c in df.columns if c not in key]
    firsts = [
        F.min(F.when(F.col(c).isNotNull(), F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(c).alias("_v")))).alias(c)
        for c in values
    ]
    return df.groupBy(*key).agg(*firsts).select(
        *[F.col(c) if c in key else F.col(f"{c}._v").alias(c) for c in df.columns]
    )


def fix_negative(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.abs(F.col(c)) for c in cols})
