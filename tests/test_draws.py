"""Distributions, invariance and edges of the draw primitives."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from wareloom.functions.draws import Draws, growth_count, growth_day_index, key_draw, padded_id, quarter_label

N = 50_000


def drawn(spark, n=N, seed=42, table="t", start=0):
    u = Draws(seed, table)
    return u.attach(spark.range(start, start + n), "id"), u


def test_uniform_integer(spark):
    df, u = drawn(spark)
    counts = [r["count"] for r in df.select(u.randint("x", 1, 10).alias("x")).groupBy("x").count().collect()]
    assert len(counts) == 10
    assert sum((c - N / 10) ** 2 / (N / 10) for c in counts) < 35  # chi square, 9 degrees, p < 1e-4


def test_keys_beyond_32_bits_differ(spark):
    df, u = drawn(spark, n=2000)
    far, _ = drawn(spark, n=2000, start=1 << 32)
    a = [r.x for r in df.select(u.bits("x").alias("x")).collect()]
    b = [r.x for r in far.select(u.bits("x").alias("x")).collect()]
    assert len(set(a) | set(b)) == 4000


def test_columns_are_independent(spark):
    df, u = drawn(spark)
    r = df.select(u.index("a", 1000).alias("a"), u.index("b", 1000).alias("b")).corr("a", "b")
    assert abs(r) < 4 / N**0.5


@pytest.mark.parametrize("weights", [{"a": 50, "b": 30, "c": 15, "d": 5}, {"x": 90, "y": 7, "z": 3}])
def test_weighted_choice(spark, weights):
    df, u = drawn(spark)
    got = {r.v: r["count"] for r in df.select(u.weighted("w", weights).alias("v")).groupBy("v").count().collect()}
    for value, w in weights.items():
        p = w / 100
        assert abs(got[value] - N * p) < 4 * (N * p * (1 - p)) ** 0.5


def test_weights_must_sum_to_100():
    with pytest.raises(ValueError):
        Draws(1, "t").weighted("w", {"a": 50})


@pytest.mark.parametrize("n", [5, 7, 100, 500, 1000])
def test_hot_fifth_takes_four_fifths(spark, n):
    df, u = drawn(spark)
    counts = sorted((r["count"] for r in df.select(u.skewed_key("k", n).alias("k")).groupBy("k").count().collect()), reverse=True)
    top = max(1, n // 5)
    assert abs(sum(counts[:top]) / N - 0.8) < 0.02
    keys = df.select(u.skewed_key("k", n).alias("k")).agg(F.min("k"), F.max("k")).first()
    assert keys[0] >= 1 and keys[1] <= n


def test_skew_edges(spark):
    df, u = drawn(spark, 2000)
    assert [r.k for r in df.select(u.skewed_key("k", 1).alias("k")).distinct().collect()] == [1]
    two = {r.k: r["count"] for r in df.select(u.skewed_key("k", 2).alias("k")).groupBy("k").count().collect()}
    assert set(two) == {1, 2} and abs(max(two.values()) / 2000 - 0.8) < 0.05


def test_dates_cover_the_range_and_its_ends(spark):
    df, u = drawn(spark, 5000)
    lo, hi = df.select(u.date_between("d", date(2024, 2, 27), date(2024, 3, 2)).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert (lo, hi) == (date(2024, 2, 27), date(2024, 3, 2))
    same = df.select(u.date_between("d", date(2024, 3, 2), date(2024, 1, 1)).alias("d")).distinct().collect()
    assert [r.d for r in same] == [date(2024, 3, 2)]


def test_partitioning_and_filters_do_not_change_draws(spark):
    u = Draws(42, "t")
    plans = [spark.range(0, 3000, 1, p) for p in (1, 3, 16)]
    results = [
        {r.id: r.x for r in u.attach(df, "id").select("id", u.bits("x").alias("x")).collect()} for df in plans
    ]
    assert results[0] == results[1] == results[2]
    part = {r.id: r.x for r in u.attach(plans[2], "id").select("id", u.bits("x").alias("x")).where("id % 7 = 3").collect()}
    assert all(results[0][k] == v for k, v in part.items())


def test_seed_changes_draws(spark):
    a, b = spark.range(100), spark.range(100)
    x = [r.x for r in a.select(key_draw(1, "n", "id").alias("x")).collect()]
    y = [r.x for r in b.select(key_draw(2, "n", "id").alias("x")).collect()]
    assert not set(x) & set(y)


def test_labels(spark):
    row = spark.range(1).select(
        padded_id("A", F.lit(7), 4).alias("a"), padded_id("A", F.lit(1234567), 4).alias("b"),
        quarter_label(F.lit(date(2024, 11, 5))).alias("q"), growth_count(1000, 0.05, F.lit(12)).alias("g"),
    ).first()
    assert (row.a, row.b, row.q, row.g) == ("A-0007", "A-1234567", "Q4", 1795)


def test_growth_dates_follow_the_curve(spark):
    start, end, rate = date(2024, 1, 1), date(2024, 12, 31), 0.2
    df, u = drawn(spark)
    u01 = u.bits("u") / F.lit(float(1 << 52))
    day = growth_day_index(u01, u.bits("d"), start, end, rate)
    months = {r.m: r["count"] for r in df.select(
        F.month(F.date_add(F.lit(start), day.cast("int"))).alias("m")).groupBy("m").count().collect()}
    total = sum(1.2**k for k in range(12))
    for k in range(12):
        p = 1.2**k / total
        assert abs(months[k + 1] - N * p) < 5 * (N * p) ** 0.5
