"""Text expressions: title case, typing errors, row fingerprints.

The ``*_text`` functions return SQL text over a value given as SQL text: an edit then
costs one call to build, however many functions it is made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def title_text(v: str) -> str:
    """Title case of a value: upper-case the first letter of every run of letters.

    A run ends at any character that is not a letter, so ``o'neil mc-donald``
    becomes ``O'Neil Mc-Donald`` (``initcap`` would only split at spaces).
    """
    runs = rf"regexp_extract_all({v}, r'(\p{{L}}+|[^\p{{L}}]+)', 1)"
    return f"array_join(transform({runs}, r -> concat(upper(left(r, 1)), lower(substring(r, 2)))), '')"


def title_case(v: str) -> Column:
    return F.expr(title_text(v))


def collapsed_text(v: str) -> str:
    """A value without outer and repeated spaces."""
    return f"regexp_replace(trim({v}), ' +', ' ')"


def typo_text(v: str, h: str) -> str:
    """One edit at an inner position: swap with the next character, delete or double it.

    Values under three characters stay. The zero-based position is 1 to length - 2.
    """
    pos = f"cast(1 + (({h} div 3) % (length({v}) - 2)) AS int)"
    head, here = f"left({v}, {pos})", f"substring({v}, {pos} + 1, 1)"
    swapped = f"concat({head}, substring({v}, {pos} + 2, 1), {here}, substring({v}, {pos} + 3))"
    deleted = f"concat({head}, substring({v}, {pos} + 2))"
    doubled = f"concat({head}, {here}, substring({v}, {pos} + 1))"
    return (f"CASE WHEN length({v}) < 3 THEN {v} WHEN {h} % 3 = 0 THEN {swapped} "
            f"WHEN {h} % 3 = 1 THEN {deleted} ELSE {doubled} END")


def canonical_text(df: DataFrame, col: str) -> Column:
    """A cell as its length and text, or ``-`` for NULL: joined cells can be told apart.

    Numbers with six decimals at most do not depend on how an engine prints them; other
    doubles keep all their digits. Timestamps keep their microseconds.
    """
    t = df.schema[col].dataType
    if isinstance(t, (T.DoubleType, T.FloatType)):
        short = F.col(col).try_cast("decimal(24,6)")
        c = F.when(short.cast("double") == F.col(col), short.cast("string")).otherwise(F.col(col).cast("string"))
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    else:
        c = F.col(col).cast("string")
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def fingerprint(df: DataFrame, cols: list[str]) -> Column:
    """60-bit number of a row's content."""
    digest = F.md5(F.concat_ws("|", *[canonical_text(df, c) for c in cols]))
    # Never NULL, so joins on numbers drawn from it need no inferred null filter, which
    # Catalyst would push down by copying the whole digest expression.
    return F.coalesce(F.conv(F.left(digest, F.lit(15)), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
