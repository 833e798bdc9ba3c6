"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from wareloom import GENERATORS, GenConfig, dirty, generate
from wareloom.operators import ranking, validate
from wareloom.plans import registry

HUGE_METHOD = 8000  # bytes; larger methods are not compiled by the JVM


def plan(df, mode="simple"):
    jvm = df.sparkSession._jvm
    kind = jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(kind)


def largest_method(df):
    return max((int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", plan(df, "codegen"))), default=0)


@pytest.mark.parametrize("industry", sorted(GENERATORS))
def test_generators_and_noise_compile_and_stay_native(spark, industry):
    cfg = GenConfig(industry, quality="heavy", months=2)
    tables = generate(spark, cfg)
    for kind, group in (("clean", tables), ("dirty", dirty(tables, cfg))):
        for name, df in group.items():
            text = plan(df)
            assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text, (kind, name)
            assert largest_method(df) < HUGE_METHOD, (kind, name)


@pytest.mark.parametrize("industry", sorted(GENERATORS))
def test_star_tables_need_no_join(spark, industry):
    """Lookups are recomputed from keys: only running ids and the churn sample join, on block totals."""
    joining = {"fact_order_items", "fact_procedures", "fact_fleet_usage", "fact_churn"}
    for name, df in generate(spark, GenConfig(industry)).items():
        if name not in joining:
            assert "Join" not in plan(df), name


def test_order_values_are_summed_without_a_shuffle(spark):
    orders = generate(spark, GenConfig("ecommerce", counts={"orders": 1_000_000}))["fact_orders"]
    assert "Exchange" not in plan(orders) and "Join" not in plan(orders)


def test_running_ids_shuffle_totals_only(spark):
    df = ranking.expand_with_running_id(spark, 1_000_000, lambda p: F.expr(f"{p} % 3"))
    text = plan(df)
    assert text.count("Exchange hashpartitioning") == 0
    assert text.count("Exchange SinglePartition") == 1  # the offsets of 977 blocks


@pytest.mark.parametrize("name", sorted(registry.all_queries()))
def test_queries_read_tables_and_use_no_python_and_no_pairwise_joins(spark, folder, name):
    text = plan(registry.all_queries()[name](spark, folder))
    assert "FileScan parquet" in text
    for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "NestedLoop"):
        assert word not in text, word


def test_profile_reads_only_what_it_needs(spark, folder):
    from wareloom.operators import profile

    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    text = plan(profile.numeric_stats({"lineitem": lines}), "formatted")
    read = re.search(r"ReadSchema: struct<(.*?)>", text)[1]
    assert "l_orderkey" in read and "l_tax" in read and "l_returnflag" not in read and "l_shipdate" not in read


def test_exact_quantiles(spark):
    df = spark.range(1, 10_002).select((F.col("id") * 7919 % 10_001).cast("double").alias("x"))
    got = {r.prob: r.value for r in validate.exact_quantiles(df, "x", [0.25, 0.5, 0.75], sketch=100).collect()}
    assert got == {0.25: 2500.0, 0.5: 5000.0, 0.75: 7500.0}


def test_exact_quantiles_with_a_hot_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1200, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    got = {r.prob: r.value for r in validate.exact_quantiles(df, "x", [0.25, 0.75], sketch=50).collect()}
    assert got == {0.25: 5.0, 0.75: 2249.0}


KINDS = [("row_number", F.row_number), ("rank", F.rank), ("dense_rank", F.dense_rank)]


def _skewed(spark, case):
    """9,000 rows whose values would fill one equal-width step: ties, an outlier, one large group, none of it, null groups."""
    i = F.col("id")
    value = {
        "even": i * 37 % 101, "ties": F.when(i % 10 == 0, i).otherwise(7), "extreme": F.when(i == 3, 10**15).otherwise(i * 7919 % 9000),
        "large_group": i * 31 % 6007, "null_group": i % 997, "decimal": (i * 37 % 1009).cast("decimal(38,2)") / 4, "double": F.sqrt(i.cast("double")),
    }[case]
    group = {"large_group": F.when(i % 20 == 0, i % 40).otherwise(0), "null_group": F.when(i % 3 == 0, i % 2)}.get(case, i % 3)
    return spark.range(9000).select("id", group.alias("g"), value.alias("v"), F.lit("x").alias("other"))


@pytest.mark.parametrize("kind,function", KINDS)
@pytest.mark.parametrize("case", ["even", "ties", "extreme", "large_group", "null_group", "decimal", "double"])
def test_value_rank_equals_a_window(spark, kind, function, case):
    from pyspark.sql import Window as W

    df, descending = _skewed(spark, case), case != "decimal"
    order = [F.desc("v") if descending else F.asc("v"), *(["id"] if kind == "row_number" else [])]
    w = W.partitionBy("g")
    size = F.size(F.collect_set("v").over(w)) if kind == "dense_rank" else F.count(F.lit(1)).over(w)
    want = {r.id: (r.w, r.n) for r in df.select("id", function().over(w.orderBy(*order)).alias("w"), size.alias("n")).collect()}
    got = ranking.value_rank(df, "v", ["id"], ["g"], kind=kind, descending=descending, steps=16)
    assert got.columns == ["id", "g", "v", "other", "_rank", "_n"]
    rows = got.collect()
    assert len(rows) == 9000 and {r.id: (r._rank, r._n) for r in rows} == want


@pytest.mark.parametrize("kind,function", KINDS)
def test_value_rank_without_groups(spark, kind, function):
    from pyspark.sql import Window as W

    df = _skewed(spark, "ties").drop("g")
    order = [F.desc("v"), *(["id"] if kind == "row_number" else [])]
    want = {r.id: r.w for r in df.select("id", function().over(W.orderBy(*order)).alias("w")).collect()}
    assert {r.id: r._rank for r in ranking.value_rank(df, "v", ["id"], kind=kind, steps=16).collect()} == want
    assert ranking.value_rank(df.limit(0), "v", ["id"], kind=kind).count() == 0


@pytest.mark.parametrize("case", ["ties", "extreme", "large_group"])
def test_no_step_is_twice_the_median(spark, case):
    """Nine tenths of the rows equal, one value far off, nearly all rows in one group: window tasks stay even."""
    keyed = _skewed(spark, case).withColumn("_key", F.struct("v", "id"))
    if case != "large_group":
        keyed = keyed.withColumn("g", F.lit(1))
    sizes = sorted(r["count"] for r in ranking.stepped(keyed, ["g"], "_key", 16).where("g IN (0, 1)").groupBy("g", "_step").count().collect())
    assert len(sizes) >= 13 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    counts = _skewed(spark, case).groupBy("g", F.col("v").alias("_key")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = sorted(r["count"] for r in ranking.stepped(counts, ["g"], "_key", 16).groupBy("g", "_step").count().collect())
    assert sizes[-1] < 1.5 * counts.count() / 16 + 64


def test_hash_rank_is_dense_over_many_buckets(spark, monkeypatch):
    from wareloom.functions.draws import key_draw

    monkeypatch.setattr(ranking, "BUCKET_ROWS", 16)
    df = spark.range(2000).withColumn("h", key_draw(1, "r", "id"))
    ranks = sorted(r._rank for r in ranking.hash_rank(df, "h", ["id"], 2000).collect())
    assert ranks == list(range(1, 2001))
    first = [r.id for r in df.orderBy("h", "id").limit(123).collect()]
    assert sorted(first) == sorted(r.id for r in ranking.sample_rows(df, "h", ["id"], 123, 2000).collect())
