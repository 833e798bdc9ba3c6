"""Rounds of keys, and the one shuffle of the customers at risk."""

import os

from pyspark.sql import functions as F

from wareloom.operators import rounds
from wareloom.plans import analyses


def _tables(spark):
    """Uses of seven customers and of none, in months and days that repeat, some days outside the calendar."""
    days = spark.range(1, 121).select(F.col("id").alias("date_key"), F.date_add(F.lit("2024-12-20").cast("date"), F.col("id").cast("int")).alias("full_date"))
    day = F.col("id") * 37 % 125
    uses = spark.range(3000).select(
        F.when(F.col("id") % 8 > 0, F.col("id") % 8).alias("customer_key"), day.alias("date_key"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 50 + F.when(day.between(43, 70), 200).otherwise(0)).cast("int").alias("api_calls"))
    return {"dim_date": days, "fact_usage": uses}


def _wanted(t):
    sums, days = {}, {r.date_key: r.full_date.strftime("%Y-%m") for r in t["dim_date"].collect()}
    for r in t["fact_usage"].collect():
        if r.date_key in days:
            at = (r.customer_key, days[r.date_key])
            old = sums.get(at)
            sums[at] = old if r.api_calls is None else (old or 0) + r.api_calls
    out, before = [], {}
    for (who, month), calls in sorted(sums.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        last = before.get(who)
        if last is not None and calls is not None and calls * 2 < last:
            out.append((who, month, calls, last))
        before[who] = calls
    return sorted(out, key=str)


def test_uses_are_shuffled_once(spark):
    t = _tables(spark)
    df = analyses.customers_at_risk(t)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and df.columns == ["customer_key", "month", "calls", "prev_calls"]
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == _wanted(t) and len(got) >= 5


def test_rounds_give_the_same_rows_and_leave_no_shuffle_files(spark, monkeypatch, tmp_path):
    t = _tables(spark)
    monkeypatch.setattr(rounds, "ROUND_ROWS", 700)
    monkeypatch.setattr(rounds, "shared_folder", lambda _: None)
    assert "Exchange hashpartitioning" in analyses.customers_at_risk(t)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rounds, "shared_folder", lambda _: str(tmp_path))
    before = spark.conf.get(rounds.CLEANUP, None)
    df = analyses.customers_at_risk(t)
    assert spark.conf.get(rounds.CLEANUP, None) == before and len(os.listdir(tmp_path)) == 5
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((tuple(r) for r in df.collect()), key=str) == _wanted(t)
