"""Distribution checks, fences per group, references and profiles against plain versions, and how often they read their tables."""

import math
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wareloom import GenConfig, dirty, generate, report, run
from wareloom.operators import profile, validate
from wareloom.plans import registry


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df, word="Relation [") -> int:
    return plan_of(df).count(word)


# --- distributions ---------------------------------------------------------------

def plain_distance(values, curve, bins=64):
    """The distance at the bins' edges, by counting at each of them."""
    u = sorted(curve(v) for v in values)
    return max(abs(sum(x < e / bins for x in u) / len(u) - e / bins) for e in range(bins + 1))


def test_distances_and_chi_squares(spark):
    rng = random.Random(4)
    rows = [(rng.random(), rng.expovariate(1), rng.choice("aabc")) for _ in range(4000)]
    df = spark.createDataFrame(rows, "x double, e double, c string").repartition(7)
    got = {r.check_name: r for r in validate.check_distributions(df, {
        "right": (F.col("c"), {"a": 2, "b": 1, "c": 1}), "wrong": (F.col("c"), {"a": 1, "b": 1, "c": 1}),
        "unknown value": (F.col("c"), {"a": 2, "b": 1}),
    }, {"even": F.col("x"), "exponential": 1 - F.exp(-F.col("e")), "not even": F.col("x") * F.col("x"), "beyond": F.col("x") * 2}).collect()}
    n = {c: sum(r[2] == c for r in rows) for c in "abc"}
    chi = lambda w: sum((n[c] - 4000 * w[c]) ** 2 / (4000 * w[c]) for c in w)
    assert abs(got["right"].statistic - chi({"a": 0.5, "b": 0.25, "c": 0.25})) < 1e-5 and got["right"].ok
    assert abs(got["wrong"].statistic - chi(dict.fromkeys("abc", 1 / 3))) < 1e-5 and not got["wrong"].ok
    assert got["unknown value"].n_outside == n["c"] and not got["unknown value"].ok
    for name, curve, ok in (("even", lambda r: r[0], True), ("exponential", lambda r: 1 - math.exp(-r[1]), True), ("not even", lambda r: r[0] ** 2, False)):
        assert abs(got[name].statistic - plain_distance(rows, curve)) < 1e-6 and got[name].ok is ok
    assert got["beyond"].n_outside == sum(r[0] > 0.5 for r in rows) and not got["beyond"].ok
    assert abs(got["wrong"].limit_value - 15.2) < 0.6  # near the 0.0005 quantile of two degrees of freedom


def test_distributions_of_few_and_odd_rows(spark):
    shares = {"s": (F.col("c"), {"a": 1, "b": 1})}
    df = spark.createDataFrame([(None, None), ("a", float("nan")), ("b", -1.0)], "c string, x double")
    got = {r.check_name: r for r in validate.check_distributions(df, shares, {"u": F.col("x")}).collect()}
    assert (got["s"].n_rows, got["s"].n_outside, got["u"].n_outside) == (3, 1, 3)
    none = validate.check_distributions(df.limit(0), shares, {"u": F.col("x")}).collect()
    assert [(r.n_rows, r.statistic, r.ok) for r in none] == [(0, 0.0, True)] * 2


def test_skew_is_reported(spark, folder):
    got = {r.check_name: r.ok for r in registry.val_distribution(spark, folder).collect()}
    assert {n for n, ok in got.items() if not ok} == {"discount, all alike", "value, even to 500"}
    wrong = spark.read.parquet(f"{folder}/lineitem.parquet").withColumn("l_returnflag", F.when(F.rand(2) < 0.1, "A").otherwise(F.col("l_returnflag")))
    (row,) = validate.check_distributions(wrong, {"flag": (F.col("l_returnflag"), {"A": 1, "N": 1, "R": 1})}, {}).collect()
    assert not row.ok


def test_all_checks_read_a_table_once(spark, folder):
    df = registry.val_distribution(spark, folder)
    assert scans(df) == 2  # line items and events


# --- fences ------------------------------------------------------------------------

def nearest_rank(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(p * len(values))) - 1]


@pytest.mark.parametrize("case", ["even", "hot", "ties"])
def test_fences_of_groups(spark, case):
    rng = random.Random(8)
    group = {"even": lambda: rng.randrange(40), "hot": lambda: 0 if rng.random() < 0.9 else rng.randrange(40), "ties": lambda: rng.choice([None, 1, 2])}[case]
    value = (lambda: rng.choice([None, 1.0, 1.0, 1.0, 5.0])) if case == "ties" else (lambda: rng.gauss(0, 10) ** 3)
    rows = [(i, group(), value()) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, g long, v double").repartition(5)
    parts = {}
    for _, g, v in rows:
        if v is not None:
            parts.setdefault(g, []).append(v)
    fences = {}
    for r in validate.group_fences(df, "v", ["g"], 1.5).collect():
        q1, q3 = nearest_rank(parts[r.g], 0.25), nearest_rank(parts[r.g], 0.75)
        assert (r.n_rows, r.q1, r.q3) == (len(parts[r.g]), q1, q3)
        fences[r.g] = q1 - (q3 - q1) * 1.5, q3 + (q3 - q1) * 1.5
    assert fences.keys() == parts.keys()
    want = {i for i, g, v in rows if v is not None and not fences[g][0] <= v <= fences[g][1]}
    got = validate.outliers(df, "v", 1.5, ["g"])
    assert {r.id for r in got.collect()} == want and got.columns == ["id", "g", "v", "low", "high"]


@pytest.mark.parametrize("name", ["val_outliers", "val_outliers_by_supplier"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_outliers_are_found(spark, name, size):
    assert registry.all_queries()[name](spark, f"/root/testdata/{size}").count() > 0


# --- references ------------------------------------------------------------------------

def test_references_read_each_table_once(spark, folder):
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("customer", "orders", "lineitem", "part", "supplier", "nation")}
    keys = {
        "customer": (["c_custkey"], {"c_nationkey": ("nation", "n_nationkey")}),
        "orders": (["o_orderkey"], {"o_custkey": ("customer", "c_custkey")}),
        "lineitem": (["l_orderkey"], {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}),
    }
    tables["part"], tables["orders"] = tables["part"].where("p_partkey % 10 <> 3"), tables["orders"].withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") - F.when(F.col("o_orderkey") % 5 == 1, 10**6).otherwise(0)))
    df = validate.reference_report(tables, keys)
    assert scans(df) == 6
    got = {(r.table_name, r.fk): (r.orphan_keys, r.orphan_rows) for r in df.collect()}
    for child, (_, fks) in keys.items():
        for fk, (parent, key) in fks.items():
            found = validate.orphan_keys(tables[child], fk, tables[parent], key).collect()
            assert got[child, fk] == (len(found), sum(r.n_rows for r in found))
    assert got["lineitem", "l_partkey"][0] > 0 and got["orders", "o_custkey"][0] > 0 and len(got) == 5


def test_references_of_text_keys_and_empty_tables(spark):
    one, two = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "k string"), spark.createDataFrame([(1,), (2,)], "n long")
    keys = {"one": ([], {"k": ("three", "k")}), "two": ([], {"n": ("four", "n")})}
    tables = {"one": one, "two": two, "three": one.where("k = 'a'"), "four": two.limit(0)}
    got = {(r.table_name, r.fk): (r.orphan_keys, r.orphan_rows) for r in validate.reference_report(tables, keys).collect()}
    assert got == {("one", "k"): (1, 2), ("two", "n"): (2, 2)}
    got = validate.reference_report({n: t.limit(0) for n, t in tables.items()}, keys).collect()
    assert sorted((r.fk, r.orphan_keys, r.orphan_rows) for r in got) == [("k", 0, 0), ("n", 0, 0)]


# --- profiles ------------------------------------------------------------------------

def test_one_reading_gives_the_whole_profile(spark, folder):
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("customer", "orders", "events", "embeddings", "region")}
    df = profile.measure(tables)
    assert scans(df) == len(tables) and scans(report.profile_rows(df)) == len(tables)
    got = {r.table_name: r for r in df.collect()}
    for r in profile.overview(tables).collect():
        assert (got[r.table_name].n_rows, got[r.table_name].n_columns) == (r.n_rows, r.n_columns)
    for r in profile.missing(tables).collect():
        assert [got[r.table_name][c] for c in ("n_missing", "n_sentinels", "n_cells", "pct_missing")] == list(r)[1:]
    stats = sorted((t, *s) for t, r in got.items() for s in r.stats)
    assert stats == sorted(map(tuple, profile.numeric_stats(tables).collect()))


def test_observed_profile_equals_the_measured_one(spark, tmp_path):
    cfg = GenConfig("retail", scale=0.2, months=1, quality="heavy")
    tables = dirty(generate(spark, cfg), cfg)
    found = {}
    for name, df in tables.items():
        found[name] = Observation(name)
        df.observe(found[name], *profile.metrics(df)).write.parquet(str(tmp_path / name))
    got = profile.observed(spark, tables, found)
    want = profile.measure(tables)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_report_has_every_section(spark, tmp_path):
    cfg = GenConfig("retail", scale=0.2, months=1, quality="heavy", format="parquet", output_dir=str(tmp_path / "shop"))
    written = run(spark, cfg)
    rows = {(r.section, r.table_name, r.metric): r.value for r in spark.read.options(header=True).csv(f"{tmp_path}/shop/csv/analysis_report").collect()}
    n = {t: df.count() for t, df in written.items()}
    assert int(rows["overview", None, "total_rows"]) == sum(n.values())
    assert all(int(rows["overview", t, "rows"]) == c for t, c in n.items())
    assert {s for s, _, _ in rows} >= {"configuration", "overview", "statistics", "missing", "noise", "retail_kpi"}
    assert ("statistics", "fact_sales", "mean revenue") in rows and ("missing", "dim_customer", "percent") in rows
