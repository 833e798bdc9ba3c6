"""Round trips through every sink and the whole run."""

import datetime

import pytest
from pyspark.sql import functions as F

from wareloom import GenConfig, dirty, generate, run
from wareloom.sources import files


def digest(df):
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in df.columns]).agg(
        F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    ).first()


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_round_trip_keeps_nulls_spaces_and_types(spark, tmp_path, fmt):
    df = spark.createDataFrame(
        [(1, None, None, None), (2, "", 1.25, True), (3, "  two  ", -3.5, False), (4, 'a "b", c', 0.0, None), (5, "null", 2.0, None)],
        "id bigint, s string, x double, b boolean",
    ).withColumn("m", F.col("x").cast("decimal(18,2)")).withColumn("d", F.lit(datetime.date(2024, 2, 29)))
    files.write_table(df, str(tmp_path), "t", fmt)
    back = files.read_table(spark, str(tmp_path), "t", fmt, df.schema)
    assert back.dtypes == df.dtypes
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_dirty_tables_survive(spark, tmp_path, fmt):
    cfg = GenConfig("retail", scale=0.2, months=1, quality="heavy")
    for name, df in dirty(generate(spark, cfg), cfg).items():
        files.write_table(df, str(tmp_path), name, fmt)
        assert digest(files.read_table(spark, str(tmp_path), name, fmt, df.schema)) == digest(df), name


def test_partitioned_write(spark, tmp_path):
    df = spark.range(100).withColumn("g", (F.col("id") % 3).cast("int"))
    folder = files.write_table(df, str(tmp_path), "t", "parquet", partition_by=["g"])
    assert {p.name for p in __import__("pathlib").Path(folder).iterdir() if p.is_dir()} == {"g=0", "g=1", "g=2"}


def test_run_writes_all_formats_and_the_report(spark, tmp_path):
    out = str(tmp_path / "shop_run")
    cfg = GenConfig("ecommerce", scale=0.2, months=1, quality="light", format="all", output_dir=out)
    written = run(spark, cfg)
    expected = dirty(generate(spark, cfg), cfg)
    for name in expected:
        assert digest(written[name]) == digest(expected[name])
        assert digest(spark.table(f"shop_run.{name}")) == digest(expected[name])
    report = spark.read.options(header=True).csv(f"{out}/csv/analysis_report")
    got = {(r.section, r.table_name, r.metric): r.value for r in report.collect()}
    assert got["configuration", None, "quality"] == "light (2%)" or got.get(("configuration", "", "quality")) == "light (2%)"
    assert got["overview", "dim_channel", "rows"] == "5"
    assert got["ecom_kpi", "fact_orders", "n_orders"] == str(expected["fact_orders"].count())
    spark.sql("DROP DATABASE shop_run CASCADE")


# --- month partitions ------------------------------------------------------------

def test_month_partitions_are_pruned_and_replaced_one_by_one(spark, tmp_path):
    cfg = GenConfig("retail", scale=0.5, months=4)
    sales = generate(spark, cfg)["fact_sales"]
    folder = files.write_months(sales, str(tmp_path), "fact_sales", "parquet", files.month_of(cfg), ["store_key"])
    back = spark.read.parquet(folder)
    months = sorted(r.month for r in back.select("month").distinct().collect())
    assert 4 <= len(months) <= 6 and digest(back.select(*sales.columns)) == digest(sales)
    calendar = generate(spark, cfg)["dim_date"].select("date_key", F.date_format("full_date", "yyyy-MM").alias("m"))
    assert back.join(calendar, "date_key").where("m <> month").isEmpty()
    one = back.where(F.col("month") == months[1])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "(month#" in plan.split("PartitionFilters: ")[1].split("]")[0] and months[1] in plan
    used = one.select(F.input_file_name().alias("f")).distinct().collect()
    assert used and all(f"month={months[1]}/" in r.f for r in used)
    before = {m: sorted(p.name for p in (tmp_path / "parquet/fact_sales" / f"month={m}").glob("*.parquet")) for m in months}
    half = spark.createDataFrame(one.drop("month").where("sale_id % 2 = 0").collect(), sales.schema)
    files.write_months(half, str(tmp_path), "fact_sales", "parquet", files.month_of(cfg), ["store_key"])
    after = {m: sorted(p.name for p in (tmp_path / "parquet/fact_sales" / f"month={m}").glob("*.parquet")) for m in months}
    assert [m for m in months if before[m] != after[m]] == [months[1]]
    assert spark.read.parquet(folder).where(F.col("month") == months[1]).count() == half.count() > 0


def test_large_months_are_ranged_over_files(spark, tmp_path):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, "2024-02").otherwise("2024-01").alias("m"), (F.col("id") * 7919 % 20_000).alias("store"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows go to one task
    try:
        folder = files.write_months(df, str(tmp_path), "t", "parquet", F.col("m"), ["store"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = spark.read.parquet(folder).where("month = '2024-01'").groupBy(F.input_file_name().alias("f")).agg(F.min("store").alias("lo"), F.max("store").alias("hi"))
    rows = sorted((r.lo, r.hi) for r in spans.collect())
    assert len(rows) > 1 and all(a[1] <= b[0] for a, b in zip(rows, rows[1:]))


# --- malformed rows ------------------------------------------------------------------

def test_malformed_rows_are_sorted_out(spark, tmp_path):
    schema = "id bigint, s string, x double, d date"
    good = spark.createDataFrame([(i, f"text {i}", i / 4, datetime.date(2024, 1, 1 + i % 28)) for i in range(50)] + [(50, None, None, None), (51, "", None, None)], schema)
    for fmt, bad in (("csv", ["x,text,1.5,2024-01-01", "7,text,one,2024-01-01", "8,too,1.0,2024-01-01,many", "9,few", "10,text,1.0,no day"]),
                     ("json", ['{"id": "x", "s": "t"}', '{"id": 1, "s": "broken', "no json at all", '{"id": 3, "x": "one"}'])):
        folder = files.write_table(good.repartition(3), str(tmp_path), "t", fmt)
        with open(f"{folder}/bad.{fmt}", "w") as f:
            f.write(("id,s,x,d\n" if fmt == "csv" else "") + "\n".join(bad) + "\n")
        counts = files.read_checked(spark, str(tmp_path), "t", fmt, good.schema, str(tmp_path / f"sorted_{fmt}"))
        assert counts == {"good": 52, "rejected": len(bad)}
        back = spark.read.parquet(str(tmp_path / f"sorted_{fmt}/parquet/t"))
        assert sorted(map(str, back.collect())) == sorted(map(str, good.collect()))
        rejects = spark.read.parquet(str(tmp_path / f"sorted_{fmt}/rejects/t")).collect()
        assert sorted(r.line for r in rejects) == sorted(bad) and all(r.file.endswith(f"bad.{fmt}") for r in rejects)


# --- replacing without a gap ---------------------------------------------------------

def failing(spark, n=100):
    return spark.range(n).select("id", F.when(F.col("id") == n - 1, F.raise_error(F.lit("lost")).cast("string")).otherwise("new").alias("s"))


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_a_failed_write_leaves_the_old_files(spark, tmp_path, fmt):
    old = spark.range(10).select("id", F.lit("old").alias("s"))
    files.replace_table(old, str(tmp_path), "t", fmt)
    with pytest.raises(Exception, match="lost"):
        files.replace_table(failing(spark), str(tmp_path), "t", fmt)
    read = lambda: files.read_table(spark, str(tmp_path), "t", fmt, old.schema)
    assert digest(read()) == digest(old) and [p.name for p in (tmp_path / fmt).iterdir()] == ["t"]
    new = read().withColumn("s", F.lit("new"))  # even of the table itself
    files.replace_table(new, str(tmp_path), "t", fmt)
    assert {r.s for r in read().collect()} == {"new"} and [p.name for p in (tmp_path / fmt).iterdir()] == ["t"]


def test_a_failed_write_leaves_the_old_catalog_table(spark, tmp_path):
    old = spark.range(10).select("id", F.lit("old").alias("s"))
    try:
        files.replace_saved(spark, old, "gapless", "t", str(tmp_path))
        with pytest.raises(Exception, match="lost"):
            files.replace_saved(spark, failing(spark), "gapless", "t", str(tmp_path))
        assert digest(spark.table("gapless.t")) == digest(old)
        files.replace_saved(spark, spark.table("gapless.t").withColumn("s", F.lit("new")), "gapless", "t", str(tmp_path))
        assert {r.s for r in spark.table("gapless.t").collect()} == {"new"}
        files.replace_saved(spark, spark.range(3), "gapless", "t", str(tmp_path))
        assert spark.table("gapless.t").columns == ["id"] and spark.table("gapless.t").count() == 3
    finally:
        spark.sql("DROP DATABASE IF EXISTS gapless CASCADE")


def test_what_cannot_be_read_back_is_not_put_in_place(spark, tmp_path, monkeypatch):
    old = spark.range(10).select("id", F.lit("old").alias("s"))
    files.replace_table(old, str(tmp_path), "t", "parquet")
    write = files._write
    monkeypatch.setattr(files, "_write", lambda df, target, fmt, **more: write(df.where("id <> 3"), target, fmt, **more))
    with pytest.raises(OSError, match="can be read"):
        files.replace_table(spark.range(10).select("id", F.lit("new").alias("s")), str(tmp_path), "t", "parquet")
    assert digest(spark.read.parquet(str(tmp_path / "parquet/t"))) == digest(old)
