"""Validation: keys, references, derived fields, outliers and rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareloom.operators.ranking import dealt_join, group_quantiles

SKETCH = 100_000  # 1 / relative rank error of the quantile sketch


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def orphan_keys(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """Foreign key values without a parent, with their number of rows.

    The child is counted per key first, so a hot key crosses the network as one row
    per task and cannot skew the anti join.
    """
    used = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("orphan_key")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    parents = parent.select(F.col(key).alias("orphan_key"))
    return used.join(parents, "orphan_key", "left_anti")


def reference_report(tables: dict[str, DataFrame], keys: dict) -> DataFrame:
    """One row per declared foreign key: orphaned key values and rows.

    Every table is scanned once. A row gives a pair (foreign key, value) for each reference it makes and for each that may
    lead to it; pairs are counted before the shuffle, so hot keys cost a row a task, and one aggregate finds the values that
    are used and not known.
    """
    refs = [(child, fk, parent, key) for child, (_, fks) in keys.items() for fk, (parent, key) in fks.items()
            if child in tables and parent in tables]
    kinds = {tables[t].schema[c].dataType for child, fk, parent, key in refs for t, c in ((child, fk), (parent, key))}
    kind = "bigint" if all(isinstance(k, T.IntegralType) for k in kinds) else "string"
    # One row a reference, so that those without any row are listed too.
    names = tables[refs[0][0]].sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_ref"), F.lit(None).cast(kind).alias("_key"), F.lit(False).alias("_used")) for i in range(len(refs))])))
    parts = [names]
    for name in {t: None for child, _, parent, _ in refs for t in (child, parent)}:
        pairs = [F.struct(F.lit(i).alias("_ref"), F.col(c).cast(kind).alias("_key"), F.lit(used).alias("_used"))
                 for i, (child, fk, parent, key) in enumerate(refs) for t, c, used in ((child, fk, True), (parent, key, False)) if t == name]
        parts.append(tables[name].select(F.inline(F.array(*pairs))).where(F.col("_key").isNotNull()))
    values = union_all(parts).groupBy("_ref", "_key").agg(
        F.count_if("_used").alias("n_rows"), F.count_if(~F.col("_used")).alias("n_known"))
    orphan = (F.col("n_rows") > 0) & (F.col("n_known") == 0)
    of = lambda at: F.element_at(F.array(*[F.lit(r[at]) for r in refs]), F.col("_ref") + F.lit(1))
    return values.groupBy("_ref").agg(
        F.count_if(orphan).alias("orphan_keys"), F.sum(F.when(orphan, F.col("n_rows")).otherwise(F.lit(0))).alias("orphan_rows")
    ).select(of(0).alias("table_name"), of(1).alias("fk"), "orphan_keys", "orphan_rows")


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wrong_totals(df: DataFrame, total: Column, expected: Column, tolerance: float = 0.01) -> DataFrame:
    """Rows whose stated total is further than ``tolerance`` from the computed one."""
    return df.withColumn("expected", expected).where(F.abs(total - expected) > F.lit(tolerance))


def exact_quantiles(df: DataFrame, col: str, probs: list[float], sketch: int = SKETCH) -> DataFrame:
    """(prob, value): exact nearest-rank quantiles without collecting the column.

    A mergeable sketch brackets each quantile; a second pass counts what lies below
    the bracket and ranks only the distinct values inside it, a share of at most
    4/sketch of the rows.
    """
    data = df.select(F.col(col).alias("_x")).where(F.col("_x").isNotNull())
    margin = 2.0 / sketch
    wanted = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)]
    pilot = data.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("_x", [float(w) for w in wanted], sketch).alias("b"),
    )
    stat = pilot.select(F.struct("n", "b").alias("s")).scalar()
    brackets = [
        F.struct(F.lit(i).alias("i"), stat["b"][2 * i].alias("lo"), stat["b"][2 * i + 1].alias("hi"))
        for i in range(len(probs))
    ]
    hits = data.select("_x", F.explode(F.array(*brackets)).alias("k"))
    hits = hits.where(F.col("_x") <= F.col("k.hi")).select(
        F.col("k.i").alias("i"), F.when(F.col("_x") >= F.col("k.lo"), F.col("_x")).alias("_x")
    )
    counts = hits.groupBy("i", "_x").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("i").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + F.lit(1))
    ranked = counts.withColumns({"seen": F.sum("c").over(w), "prob": prob})
    reached = F.col("seen") >= F.greatest(F.lit(1), F.ceil(F.col("prob") * stat["n"]))
    return ranked.where(F.col("_x").isNotNull() & reached).groupBy("prob").agg(F.min("_x").alias("value"))


def iqr_bounds(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """One row: quartiles and the fences below and above which values are outliers."""
    q = exact_quantiles(df, col, [0.25, 0.75]).agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
    )
    spread = (F.col("q3") - F.col("q1")) * F.lit(k)
    return q.select("q1", "q3", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def group_fences(df: DataFrame, col: str, group: list[str], k: float = 1.5) -> DataFrame:
    """(group columns, n_rows, q1, q3, low, high) of every group with a value."""
    q = group_quantiles(df, col, [0.25, 0.75], group)
    spread = (F.col("q1") - F.col("q0")) * F.lit(k)
    return q.select(*group, F.col("_rows").alias("n_rows"), F.col("q0").alias("q1"), F.col("q1").alias("q3"),
                    (F.col("q0") - spread).alias("low"), (F.col("q1") + spread).alias("high"))


def outliers(df: DataFrame, col: str, k: float = 1.5, group: list[str] | None = None) -> DataFrame:
    """Rows outside the interquartile fences of a column, or of their group's part of it (then with ``low`` and ``high``)."""
    if group:
        fences = group_fences(df, col, group, k).select(*[F.col(g).alias(f"_f{i}") for i, g in enumerate(group)], "n_rows", "low", "high")
        fenced = dealt_join(df.where(F.col(col).isNotNull()), fences, [(g, f"_f{i}") for i, g in enumerate(group)], "n_rows", F.xxhash64(*df.columns))
        return fenced.where((F.col(col) < F.col("low")) | (F.col(col) > F.col("high")))
    fences = iqr_bounds(df, col, k)
    low, high = fences.select("low").scalar(), fences.select("high").scalar()
    return df.where((F.col(col) < low) | (F.col(col) > high))


#: A sample of the declared distribution fails a check about once in two thousand times: normal deviate, factor of 1 / sqrt(n).
DEVIATE, DISTANCE = 3.29, 2.04
BINS = 64


def check_distributions(df: DataFrame, shares: dict[str, tuple[Column, dict]], curves: dict[str, Column], bins: int = BINS) -> DataFrame:
    """(check_name, kind, n_rows, n_outside, statistic, limit_value, ok): do columns follow declared distributions? One pass over the rows.

    ``shares`` names a column and the weights of its values; the statistic is chi-square, its limit the Wilson-Hilferty quantile.
    ``curves`` names the declared distribution function of a value, an expression from 0 to 1; the statistic is the Kolmogorov-Smirnov
    distance at the edges of ``bins`` equally likely bins, which is at most the distance itself. Rows become (check, cell) pairs that are
    counted before the shuffle; a value that is NULL, not declared or beyond the curve is outside and fails its check, and
    all such values share one cell, so there are no more cells than declared.
    """
    names = [*shares, *curves]
    cells, weights, limits = [], [], []
    for c, declared in shares.values():
        cells.append(F.coalesce(F.array_position(F.array(*[F.lit(v) for v in declared]), c) - F.lit(1), F.lit(-1)))
        weights.append([w / sum(declared.values()) for w in declared.values()])
        free = len(declared) - 1
        limits.append(free * (1 - 2 / (9 * free) + DEVIATE * (2 / (9 * free)) ** 0.5) ** 3 if free else 0.0)
    for u in curves.values():
        cells.append(F.when(u.between(0, 1), F.least(F.floor(u * F.lit(bins)), F.lit(bins - 1))).otherwise(F.lit(-1)))
        weights.append([1 / bins] * bins)
    seen = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_check"), c.cast("int").alias("_cell"), F.lit(1).cast("bigint").alias("_n")) for i, c in enumerate(cells)])))
    none = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("_check"), F.lit(-1).alias("_cell"), F.lit(0).cast("bigint").alias("_n"))
    counts = seen.unionByName(none).groupBy("_check", "_cell").agg(F.sum("_n").alias("_n"))
    # As many rows as declared cells from here on.
    inside = F.when(F.col("_cell") >= 0, F.col("_n")).otherwise(F.lit(0))
    whole = W.partitionBy("_check")
    so_far = F.sum(inside).over(whole.orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counts.withColumns({"_in": F.sum(inside).over(whole).cast("double"), "_below": so_far})
    share = F.element_at(F.element_at(F.array(*[F.array(*[F.lit(float(w)) for w in ws]) for ws in weights]), F.col("_check") + 1), F.col("_cell") + 1)
    n, cell, below = F.col("_n").cast("double"), F.col("_cell"), F.col("_below")
    chi = F.sum(F.when(cell >= 0, n * n / (F.col("_in") * share))) - F.max("_in")
    gap = F.max(F.when((cell >= 0) & (F.col("_in") > 0), F.greatest(
        F.abs(below / F.col("_in") - (cell + 1) / F.lit(float(bins))), F.abs((below - n) / F.col("_in") - cell / F.lit(float(bins))))))
    is_curve = F.col("_check") >= len(shares)
    out = placed.groupBy("_check").agg(
        F.sum("_n").alias("n_rows"), F.sum(F.when(cell < 0, F.col("_n")).otherwise(F.lit(0))).alias("n_outside"),
        chi.alias("_chi"), gap.alias("_gap"), F.max("_in").alias("_in"))
    limit = F.element_at(F.array(*[F.lit(x) for x in [*limits, *[0.0] * len(curves)]]), F.col("_check") + 1)
    out = out.select(
        F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_check") + 1).alias("check_name"),
        F.when(is_curve, "distance").otherwise("chi-square").alias("kind"), "n_rows", "n_outside",
        F.round(F.coalesce(F.when(is_curve, F.col("_gap")).otherwise(F.col("_chi")), F.lit(0.0)), 6).alias("statistic"),
        F.round(F.when(is_curve, F.lit(DISTANCE) / F.sqrt(F.greatest(F.col("_in"), F.lit(1.0)))).otherwise(limit), 6).alias("limit_value"))
    return out.withColumn("ok", (F.col("n_outside") == 0) & (F.col("statistic") <= F.col("limit_value")))


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations, n_rows): all rules of a table in one pass.

    A rule is a predicate that is true where the row violates it.
    """
    names = list(rules)
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.coalesce(F.sum(F.when(rules[n], 1).otherwise(0).cast("bigint")), F.lit(0)).alias(f"_v{i}") for i, n in enumerate(names)],
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_v{i}").alias("n_violations")) for i, n in enumerate(names)])
    return one.select("n_rows", F.inline(pairs)).select("rule", "n_violations", "n_rows")
