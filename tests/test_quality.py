"""Noise operators on hand-made rows and on generated tables."""

import pytest
from pyspark.sql import functions as F

from wareloom import GenConfig, dirty, generate
from wareloom.functions.text import fingerprint, title_case, typo_text
from wareloom.operators import clean, identity, quality


def test_protected_columns():
    assert all(quality.is_protected(c) for c in ("customer_key", "ORDER_ID", "date_key", "session_id", "paid_identity"))
    assert not any(quality.is_protected(c) for c in ("sku", "icd10_code", "ssn_last4", "c_custkey"))
    assert quality.is_protected("c_custkey", ["c_custkey"])


def test_null_rule():
    assert quality.null_rate("phone", 0.1, True) == pytest.approx(0.06)
    assert quality.null_rate("is_holiday", 0.1, True) == pytest.approx(0.009)
    assert quality.null_rate("paid_amount", 0.1, False) == pytest.approx(0.015)
    assert quality.null_rate("fax", 0.5, False) == 0.2


def test_title_case(spark):
    rows = spark.createDataFrame([("o'neil mc-donald",), ("  x  y ",), ("ÉCOLE 2nd",), (None,), ("",)], "s string")
    assert [r[0] for r in rows.select(title_case("s")).collect()] == ["O'Neil Mc-Donald", "  X  Y ", "École 2Nd", None, ""]


def test_typo_edits(spark):
    rows = spark.createDataFrame(
        [("", 0), ("ab", 0), (None, 0), ("abc", 0), ("abc", 1), ("abc", 2), ("abcde", 6), ("abcde", 7), ("abcde", 8)],
        "s string, h bigint")
    got = [r[0] for r in rows.select(F.expr(typo_text("s", "h"))).collect()]
    assert got == ["", "ab", None, "acb", "ac", "abbc", "abced", "abce", "abcdde"]


def test_country_rule(spark):
    values = ["USA", "usa", "England", "Germany", None]
    df = spark.range(2000).select("id", F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % 5 + 1).cast("int")).alias("country"))
    n = quality.Noise(42, 0.5, "id")
    out = n.detach(n.country(n.attach(df))).withColumnRenamed("country", "new").join(df, "id")
    assert out.where("country IN ('Germany') AND new <> country OR country IS NULL AND new IS NOT NULL").count() == 0
    changed = {r.new for r in out.where("country = 'England'").select("new").distinct().collect()}
    assert changed == {"UK", "United Kingdom", "Great Britain", "GB", "England"}
    back = clean.clean_country(out.select("id", F.col("new").alias("country")))
    assert {r.country for r in back.select("country").distinct().collect()} == {"USA", "UK", "Germany", None}


@pytest.mark.parametrize("rows,expected", [(9, 0), (10, 0), (1000, 10)])
def test_duplicate_counts(spark, rows, expected):
    df = quality.inject_duplicates(spark.range(1, rows + 1), 0.5, 42, "id", rows)
    assert df.where("_copy_no > 0").count() == expected and df.where("_copy_no = 0").count() == rows


def test_duplicates_are_drawn_with_replacement(spark):
    df = quality.inject_duplicates(spark.range(1, 20_001), 0.5, 42, "id", 20_000)
    copies = df.where("_copy_no > 0")
    assert copies.count() == 200
    assert copies.where("id NOT BETWEEN 1 AND 20000").count() == 0
    assert copies.groupBy("id").agg(F.max("_copy_no").alias("m"), F.count("*").alias("n")).where("m <> n").count() == 0


def test_time_travel(spark):
    df = spark.createDataFrame([(i, s, "2024-06-01") for i, s in enumerate([None, "not a date", "2024-03-01"] * 50)],
                               "id bigint, s string, e string")
    out = quality.inject_time_travelers(df, "s", "e", "id", rate=1.0)
    assert out.where("(s IS NULL OR s = 'not a date') AND e <> '2024-06-01'").count() == 0
    ends = {r.e for r in out.where("s = '2024-03-01'").collect()}
    assert ends <= {f"2024-02-{d}" for d in range(20, 30)} and len(ends) > 4
    assert quality.inject_time_travelers(df, "missing", "e", "id") is df


def test_orphans_point_beyond_the_maximum(spark):
    df = spark.range(1, 5001).withColumn("fk", F.col("id") % 100 + 1)
    out = quality.inject_orphans(df, "fk", "id", rate=0.02)
    hit = out.where("fk > 100")
    assert 60 <= hit.count() <= 140
    assert hit.select("fk").distinct().count() == 1 and 1100 <= hit.first().fk <= 10099


def test_numbered_copies_with_a_hot_row(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id") % 500).alias("v"))
    out = identity.number_copies(df, chunk=64)
    assert out.count() == 3000
    bad = out.groupBy("v").agg(F.min("_dup_no").alias("lo"), F.max("_dup_no").alias("hi"), F.countDistinct("_dup_no").alias("d"), F.count("*").alias("n"))
    assert bad.where("lo <> 1 OR hi <> n OR d <> n").count() == 0


def test_fingerprints_are_computed_below_the_shuffle(spark):
    """However often the identity is read, its readers share the shuffle and none repeats the digest; draws need no null checks."""
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, None), (None, None)], "a int, b string")
    out = identity.identify(df, 7)
    above, found = out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0], out.collect()
    assert "md5" not in above
    assert not out.schema["_row_key"].nullable
    prints = df.select("*", fingerprint(df, df.columns).alias("p")).collect()
    assert {(r.a, r.b, r._print) for r in found} == {tuple(r) for r in prints}
    assert sorted((r.a or 0, r._dup_no) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)]
    assert len({r._row_key for r in found}) == 5


def test_clean_level_returns_the_tables(spark):
    cfg = GenConfig("retail", scale=0.2, months=1)
    tables = generate(spark, cfg)
    assert dirty(tables, cfg) == tables


@pytest.mark.parametrize("industry", ["retail", "saas", "logistics"])
def test_dirty_tables_keep_keys_and_types(spark, industry):
    cfg = GenConfig(industry, months=2, quality="heavy")
    clean_tables, dirty_tables = generate(spark, cfg), None
    dirty_tables = dirty(clean_tables, cfg)
    for name, df in dirty_tables.items():
        before = quality.landing(clean_tables[name])
        assert [f.dataType for f in df.schema.fields] == [f.dataType for f in before.schema.fields], name
        keys = [c for c in df.columns if quality.is_protected(c)]
        assert df.select(keys).subtract(before.select(keys)).count() == 0, name
        extra = df.count() - before.count()
        n = before.count()
        assert extra == (0 if name.startswith("dim_") else quality.duplicate_count(n, 0.10)), name


def test_null_share_and_spellings(spark):
    df = spark.range(1, 40_001).select("id", F.lit("abc").alias("phone"), F.lit(1.5).alias("amount"))
    n = quality.Noise(42, 0.5, "id", ["id"])
    out = n.detach(n.nulls(n.attach(df), True))
    counts = {r.phone: r["count"] for r in out.groupBy("phone").count().collect()}
    hit = 40_000 * 0.2  # the cap
    for value, share in ((None, 0.55), ("", 0.2), ("N/A", 0.15), ("null", 0.1)):
        assert abs(counts[value] - hit * share) < 5 * (hit * share) ** 0.5
    assert abs(out.where("amount IS NULL").count() - 40_000 * 0.15) < 5 * (40_000 * 0.15) ** 0.5


def test_dirty_clean_round_trip(spark):
    cfg = GenConfig("retail", quality="heavy")
    sales = generate(spark, cfg)["fact_sales"]
    noisy = quality.inject_fact(sales, 0.5, 42, "sale_id", 5000, keep_copy_no=True)
    back = clean.dedupe(noisy, ["sale_id"], ["_copy_no"])
    assert back.count() == 5000 and back.select("sale_id").subtract(sales.select("sale_id")).count() == 0
    fixed = clean.fix_negative(back, ["quantity"])
    assert noisy.where("quantity < 0").count() > 0 and fixed.where("quantity < 0").count() == 0


def test_dedupe_variants(spark):
    df = spark.createDataFrame([(1, 2, "b", None), (1, 1, None, "x"), (1, 3, "c", "z"), (2, 1, "q", None)],
                               "k bigint, o int, v string, w string")
    get = lambda keep: {r.k: (r.o, r.v, r.w) for r in clean.dedupe(df, ["k"], ["o"], keep).collect()}
    assert get("first") == {1: (1, None, "x"), 2: (1, "q", None)}
    assert get("last") == {1: (3, "c", "z"), 2: (1, "q", None)}
    assert get("merge") == {1: (1, "b", "x"), 2: (1, "q", None)}


def test_sentinels_are_told_from_nulls(spark):
    from wareloom.operators import profile

    df = spark.createDataFrame([(None,), ("",), ("N/A",), ("null",), ("NULL ",), ("ok",)], "s string")
    row = profile.missing({"t": df}).first()
    assert (row.n_missing, row.n_sentinels, row.n_cells) == (1, 3, 6)
    assert clean.sentinels_to_null(df).where("s IS NULL").count() == 5


def test_profile_takes_odd_doubles(spark):
    """NaN is missing; values beyond the decimal fall back to doubles; every numeric column counts."""
    from wareloom.operators import profile

    rows = [(float("nan"), 1e20, 1, 2, 3), (2.0, 1.0, 1, 2, 3), (4.0, None, 1, 2, 5)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d int, e int")
    got = {r.column_name: (r.min_value, r.max_value, r.mean_value) for r in profile.numeric_stats({"t": df}).collect()}
    assert got == {"a": (2.0, 4.0, 3.0), "b": (1.0, 1e20, 5e19 + 0.5), "c": (1, 1, 1), "d": (2, 2, 2), "e": (3, 5, 11 / 3)}


def test_row_prints_do_not_collide(spark):
    from wareloom.functions.text import fingerprint

    rows = [("a|b", "c", 1.0), ("a", "b|c", 1.0), (None, "x", 1.0), ("~", "x", 1.0), ("-", "x", 1.0), ("a", "b", 1e20), ("a", "b", 1e-9), ("a", "b", 2e-9)]
    df = spark.createDataFrame(rows, "a string, b string, x double")
    assert df.select(fingerprint(df, df.columns).alias("p")).distinct().count() == len(rows)


def test_copies_never_broadcast_the_table(spark, monkeypatch):
    """A table that the planner takes for small is streamed; few and many picks give the same copies."""
    keys = spark.range(0, 50, 1, 1)
    df = keys.select(F.explode(F.sequence(F.col("id") * 100 + 1, F.col("id") * 100 + 100)).alias("k")).withColumn("v", F.col("k") * 3)
    df = df.unionByName(spark.createDataFrame([(None, 7), (17, 51)], "k bigint, v bigint"))  # a null and a repeated key
    few = quality.inject_duplicates(df, 0.5, 3, "k", 5000)
    want = sorted((r.k, r.v, r._copy_no) for r in few.where("_copy_no > 0").collect())
    assert len(want) >= 50
    monkeypatch.setattr(quality, "FEW_PICKS", 4)
    many = quality.inject_duplicates(df, 0.5, 3, "k", 5000)
    assert sorted((r.k, r.v, r._copy_no) for r in many.where("_copy_no > 0").collect()) == want
    for plan in (few, many):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in text
    assert "SortMergeJoin" in text


@pytest.mark.parametrize("given", [False, True])
def test_repeated_stock_rows_are_looked_up(spark, monkeypatch, given):
    """The stock table is generated once; its repeated rows come from the drawn positions and equal those found in the table."""
    from wareloom.plans import dataset

    keys = spark.createDataFrame([(1,), (1,), (None,)] + [(i,) for i in range(4, 41)], "k bigint")  # a repeated and a missing key
    cfg = GenConfig("retail", quality="heavy", counts={"products": 40, "stores": 300}, keys={"products": keys} if given else {})
    monkeypatch.setattr(quality, "FEW_PICKS", 4)
    stock = dataset.table(spark, cfg, "fact_inventory")
    noisy = dirty({"fact_inventory": stock}, cfg)["fact_inventory"]
    text = noisy._jdf.queryExecution().executedPlan().toString()
    assert text.count("explode(sequence((_first" if given else "Range (0, 12000") == 1
    key, _ = dataset._row_key(cfg, "fact_inventory")
    found = quality.inject_fact(stock.withColumn("_row_key", key), cfg.quality_rate, cfg.seed, "_row_key", 12_000).drop("_row_key")
    got = sorted(noisy.collect(), key=str)
    assert got == sorted(found.collect(), key=str) and len(got) >= (12_000 if not given else 11_700) + 20


def test_repeated_rows_of_a_derived_table_come_from_it(spark):
    from wareloom.plans import dataset

    cfg = GenConfig("retail", quality="heavy", counts={"products": 40, "stores": 300})
    half = dataset.table(spark, cfg, "fact_inventory").where("store_key <= 150")
    noisy = dirty({"fact_inventory": half}, cfg)["fact_inventory"]
    assert noisy.where("store_key > 150").count() == 0 and noisy.count() > 6000
