"""Row counts, ranges, relations and invariance of the generated tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from wareloom import GENERATORS, GenConfig, generate
from wareloom.operators.validate import duplicate_keys, reference_report
from wareloom.plans import banking, dataset
from wareloom.plans.model import KEYS

BASE = {
    "retail": {"dim_customer": 500, "dim_product": 100, "dim_store": 20, "fact_sales": 5000, "fact_inventory": 2000},
    "ecommerce": {"dim_customer": 500, "dim_product": 100, "dim_channel": 5, "fact_orders": 2000, "fact_web_events": 20000},
    "banking": {"dim_customer": 500, "dim_account": 800, "dim_branch": 30, "fact_transactions": 10000, "fact_loans": 166, "fact_cards": 5000},
    "healthcare": {"dim_patient": 500, "dim_doctor": 50, "dim_hospital": 10, "dim_diagnosis": 10, "fact_encounters": 3000, "fact_billing": 3000},
    "saas": {"dim_customer": 300, "dim_plan": 5, "dim_product": 5, "fact_usage": 36100},
    "logistics": {"dim_route": 100, "dim_vehicle": 50, "dim_warehouse": 10, "fact_shipments": 5000, "fact_deliveries": 5000},
}


@pytest.fixture(scope="module")
def base(spark):
    return {i: generate(spark, GenConfig(i)) for i in GENERATORS}


def test_forty_two_tables():
    assert sum(len(t) for t in GENERATORS.values()) == 42
    assert {i: set(t) for i, t in GENERATORS.items()} == {i: set(t) for i, t in KEYS.items()}


@pytest.mark.parametrize("industry", sorted(BASE))
def test_row_counts_keys_and_references(base, industry):
    tables = base[industry]
    assert tables["dim_date"].count() == 361
    for name, n in BASE[industry].items():
        assert tables[name].count() == n, name
    for name, (pk, _) in KEYS[industry].items():
        assert duplicate_keys(tables[name], pk).count() == 0, name
    report = reference_report(tables, KEYS[industry]).collect()
    assert report and all(r.orphan_rows == 0 for r in report)


def test_calendar(spark):
    cfg = GenConfig("retail", as_of=date(2025, 1, 31), months=60)
    rows = {r.full_date: r for r in generate(spark, cfg)["dim_date"].collect()}
    assert len(rows) == 1801 and max(rows) == date(2025, 1, 31)
    assert rows[date(2021, 1, 3)].week == 53 and rows[date(2024, 12, 30)].week == 1
    assert rows[date(2024, 12, 25)].is_holiday and not rows[date(2024, 12, 26)].is_holiday
    assert rows[date(2024, 2, 29)].day_name == "Thursday" and rows[date(2024, 2, 29)].day_of_week == 3
    assert rows[date(2024, 3, 2)].is_weekend and rows[date(2024, 3, 2)].quarter == "Q1"


def test_retail_identities(base):
    sales, products = base["retail"]["fact_sales"], base["retail"]["dim_product"].withColumnRenamed("unit_price", "list_price")
    joined = sales.join(products, "product_key")
    bad = joined.where(
        (F.col("unit_price") != F.col("list_price"))
        | (F.col("revenue") + F.col("discount") != F.col("unit_price") * F.col("quantity"))
        | (F.col("discount") > F.col("unit_price") * F.col("quantity") * 0.2 + 0.01)
    )
    assert joined.count() == 5000 and bad.count() == 0
    costs = products.where((F.col("unit_cost") < F.col("list_price") * 0.4 - 0.01) | (F.col("unit_cost") > F.col("list_price") * 0.7 + 0.01))
    assert costs.count() == 0


def test_order_value_is_the_sum_of_its_lines(base):
    t = base["ecommerce"]
    items = t["fact_order_items"]
    per = items.groupBy("order_id").agg(F.sum("line_total").alias("s"), F.count("*").alias("n"))
    joined = t["fact_orders"].join(per, "order_id", "left")
    assert joined.where(F.col("s").isNull() | (F.col("s") != F.col("order_value")) | ~F.col("n").between(1, 5)).count() == 0
    ids = items.agg(F.min("item_id"), F.max("item_id"), F.count("*")).first()
    assert ids[0] == 1 and ids[1] == ids[2] and 2000 <= ids[2] <= 10000


def test_billing_identities(base):
    t = base["healthcare"]
    joined = t["fact_billing"].join(t["fact_encounters"].withColumnRenamed("total_charges", "c"), "encounter_id")
    wrong = joined.where(
        (F.col("total_charges") != F.col("c"))
        | (F.col("patient_responsibility") != F.col("total_charges") - F.col("paid_amount"))
        | (F.col("paid_amount") > F.col("allowed_amount"))
    )
    assert joined.count() == 3000 and wrong.count() == 0
    out = t["fact_encounters"].where("visit_type = 'Outpatient' AND (length_of_stay <> 0 OR total_charges > 1000)")
    assert out.count() == 0


def test_procedures_inherit_the_doctor(base):
    t = base["healthcare"]
    enc = t["fact_encounters"].select("encounter_id", F.col("doctor_key").alias("d"))
    joined = t["fact_procedures"].join(enc, "encounter_id")
    assert joined.where("doctor_key <> d").count() == 0 and joined.count() == t["fact_procedures"].count()


def test_bank_signs_and_instalment(spark, base):
    txns = base["banking"]["fact_transactions"]
    wrong = txns.where((F.col("amount") < 0) != F.col("transaction_type").isin(banking.OUTFLOWS))
    assert wrong.count() == 0
    payment = spark.range(1).select(
        banking.monthly_payment(F.lit(100000.0), F.lit(600), F.lit(360.0)).cast("decimal(18,2)").alias("p")
    ).first().p
    assert str(payment) == "599.55"


def test_subscriptions_start_with_the_signup(base):
    t = base["saas"]
    days = t["dim_date"].select(F.col("date_key").alias("snapshot_date_key"), "full_date", "day")
    joined = t["fact_subscriptions"].join(days, "snapshot_date_key").join(t["dim_customer"], "customer_key")
    assert joined.where("day <> 1 OR full_date < signup_date").count() == 0
    assert joined.where("plan_key = 1 AND (seats <> 1 OR mrr <> 0)").count() == 0
    month_starts = t["dim_date"].where("day = 1").count()
    expected = t["dim_customer"].join(t["dim_date"].where("day = 1"), F.col("full_date") >= F.col("signup_date")).count()
    assert t["fact_subscriptions"].count() == expected <= month_starts * 300


def test_churn_is_a_sample_without_replacement(base):
    t = base["saas"]
    churn = t["fact_churn"].join(t["dim_customer"], "customer_key").join(t["dim_date"], "date_key").collect()
    assert 0 < len(churn) <= 45 and len({r.customer_key for r in churn}) == len(churn)
    assert all(1 <= r.churn_id <= 45 and (r.full_date - r.signup_date).days >= 30 for r in churn)
    assert all(r.tenure_months == (r.full_date - r.signup_date).days // 30 for r in churn)


def test_deliveries(base):
    t = base["logistics"]
    d = t["fact_deliveries"]
    assert d.where("delivery_status = 'Delivered' AND (on_time IS NULL OR actual_transit_days < 1)").count() == 0
    assert d.where("delivery_status <> 'Delivered' AND (on_time IS NOT NULL OR actual_transit_days IS NOT NULL)").count() == 0
    assert d.where("expected_transit_days = 1 AND actual_transit_days = 1 AND NOT on_time").count() == 0
    route = t["dim_route"].where("origin_city = destination_city")
    assert route.count() == 0


def test_fleet_usage_covers_active_vehicles_only(base):
    t = base["logistics"]
    active = t["dim_vehicle"].where("status = 'Active'")
    used = t["fact_fleet_usage"]
    n = used.count()
    assert used.join(active, "vehicle_key", "left_anti").count() == 0
    expected = active.count() * 361 * 0.7
    assert abs(n - expected) < 5 * (expected * 0.3) ** 0.5
    assert used.agg(F.max("usage_id"), F.countDistinct("usage_id")).first()[:] == (n, n)


@pytest.mark.parametrize("industry", sorted(BASE))
def test_same_rows_for_other_partitions_and_without_adaptive_plans(spark, industry):
    cfg = GenConfig(industry, scale=0.2, months=2)

    def digest():
        return {
            n: df.agg(F.count("*"), F.sum(F.hash(*df.columns).cast("bigint"))).first() for n, df in generate(spark, cfg).items()
        }

    first = digest()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert digest() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_running_ids_across_blocks(spark):
    from wareloom.functions.draws import key_draw
    from wareloom.operators import ranking

    count_of = lambda p: key_draw(1, "x", p) % 4
    got = [tuple(r) for r in ranking.expand_with_running_id(spark, 1000, count_of, block=7).orderBy("running_id").collect()]
    counts = [r.c for r in spark.range(1000).select(count_of("id").alias("c")).collect()]
    want, k = [], 0
    for p, c in enumerate(counts):
        for o in range(1, c + 1):
            k += 1
            want.append((p, o, k))
    assert got == want


def test_running_ids_in_two_levels_and_without_broadcast(spark, monkeypatch):
    from wareloom.operators import ranking

    monkeypatch.setattr(ranking, "FLAT_LIMIT", 10)
    monkeypatch.setattr(ranking, "GROUP", 4)
    monkeypatch.setattr(ranking, "BROADCAST_BLOCKS", 1)
    df = ranking.expand_with_running_id(spark, 500, lambda p: F.expr(f"{p} % 3"), block=5)
    rows = df.orderBy("position", "ordinal").collect()
    assert [r.running_id for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == 499


def test_config_rules():
    assert GenConfig("retail", months=99).n_days == 99 * 30 + 1
    assert GenConfig("retail", quality="heavy").quality_rate == 0.10
    assert GenConfig("retail", quality_rate=3).quality_rate == 0.5
    assert GenConfig("healthcare", size="small").n("hospitals") == 2
    assert GenConfig("banking", size="large").n("accounts") == 4000
    assert GenConfig("retail", as_of=date(2025, 1, 31)).start_date == date(2024, 2, 6)
    for bad in ({"industry": "mining"}, {"industry": "retail", "scale": 0.001}, {"industry": "retail", "size": "giant"},
                {"industry": "retail", "months": 0}, {"industry": "retail", "growth_rate": 80}, {"industry": "retail", "counts": {"pets": 3}}):
        with pytest.raises(ValueError):
            GenConfig(**bad)


def test_known_rows_match(spark, base):
    for industry, tables in base.items():
        for name, df in tables.items():
            n = dataset.known_rows(GenConfig(industry), name)
            assert n is None or n == df.count(), name


def test_gaps_between_given_keys_change_nothing(spark, folder, tmp_path):
    """Keys times 7, shifted and shuffled, generate what dense keys do: rows follow the rank of the key."""
    from wareloom.plans import scaled

    for t, key in scaled.COUNTED.items():
        df = spark.read.parquet(f"{folder}/{t}.parquet")
        df.withColumn(key, F.col(key) * 7 - 1000).orderBy(F.rand(3)).write.parquet(f"{tmp_path}/{t}.parquet")
    for industry in ("retail", "ecommerce", "logistics"):
        dense, sparse = (dataset.generate(spark, scaled.config(spark, str(d), industry)) for d in (folder, tmp_path))
        for name in dense:
            assert dense[name].exceptAll(sparse[name]).isEmpty() and sparse[name].count() == dense[name].count(), name
    assert dense.keys() == sparse.keys()
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert dataset.table(spark, scaled.config(spark, folder, "retail"), "fact_sales").count() == lines


def test_dense_index(spark):
    from wareloom.operators.ranking import dense_index

    keys = sorted({(-1) ** i * i**5 for i in range(3000)} | set(range(5000, 9000)))
    df = spark.createDataFrame([(k,) for k in keys], "k long").orderBy(F.rand(1))
    got = {r.key: r["index"] for r in dense_index(spark, df, keys[0], keys[-1]).collect()}
    assert got == {k: i + 1 for i, k in enumerate(keys)}


def test_sizes_follow_the_files(spark, folder, tmp_path):
    """A folder that changes within a session is measured again."""
    from wareloom.plans import scaled

    for t in scaled.COUNTED:
        spark.read.parquet(f"{folder}/{t}.parquet").limit(50).write.parquet(f"{tmp_path}/{t}.parquet")
    assert scaled.extent(spark, str(tmp_path)).counts["part"] == 50
    spark.read.parquet(f"{folder}/part.parquet").limit(70).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    assert scaled.extent(spark, str(tmp_path)).counts["part"] == 70


def _given(spark, industry, n=40, **counts):
    """A configuration over given keys that all lie in one task."""
    keys = spark.range(1, n + 1, 1, 1).withColumnRenamed("id", "k")
    cfg = GenConfig(industry, months=3, quality="heavy")
    entities = {"retail": ("products",), "saas": ("customers",)}[industry]
    return cfg.with_(counts={e: n for e in entities} | counts, keys={e: keys for e in entities})


def _text(df):
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_shares_of_keys_expand_after_the_shuffle(spark, monkeypatch):
    """Only chunks of the keys are shuffled; their positions never are."""
    from wareloom.operators import ranking
    from wareloom.plans import common

    monkeypatch.setattr(ranking, "SMALL_TASK_ROWS", 10)
    cfg = _given(spark, "retail", stores=30)
    for chunk in (common.CHUNK, 7):
        monkeypatch.setattr(common, "CHUNK", chunk)
        stock = dataset.table(spark, cfg, "fact_inventory")
        lines = _text(stock).splitlines()
        at = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(_first" in x]
        assert len(at) == 1 and "Exchange" not in "".join(lines[:at[0]]) and any("Generate explode(sequence" in x for x in lines[:at[0]])
        pairs = sorted((r.product_key, r.store_key) for r in stock.collect())
        assert pairs == [(p, s) for p in range(1, 41) for s in range(1, 31)]


def test_snapshots_of_given_customers_spread_before_they_expand(spark, monkeypatch):
    from wareloom.operators import ranking

    monkeypatch.setattr(ranking, "SMALL_TASK_ROWS", 10)
    plain = GenConfig("saas", months=3, counts={"customers": 40})
    given = dataset.table(spark, _given(spark, "saas").with_(quality="clean"), "fact_subscriptions")
    lines = _text(given).splitlines()
    explode, exchange = (next(i for i, x in enumerate(lines) if w in x) for w in ("Generate explode", "Exchange hashpartitioning(customer_key"))
    assert explode < exchange
    assert sorted(given.collect()) == sorted(dataset.table(spark, plain, "fact_subscriptions").collect())


def test_usage_is_not_filtered_by_the_signup_of_its_customer(spark):
    """No condition on the drawn signup day crosses the join of snapshots and usage; the copied draws made a method too large to compile."""
    from wareloom.plans import analyses

    cfg = _given(spark, "saas").with_(quality="clean")
    df = analyses.usage_vs_upgrades({t: dataset.table(spark, cfg, t) for t in ("fact_subscriptions", "fact_usage")})
    assert max(len(x) for x in _text(df).splitlines() if " Filter " in x) < 500


def test_long_shares_expand_by_blocks(spark, monkeypatch):
    """Shares of many positions, whole and cut into pieces; keys that occur twice or are missing."""
    from wareloom.operators import ranking
    from wareloom.plans import common

    monkeypatch.setattr(ranking, "SMALL_TASK_ROWS", 10)
    keys = spark.createDataFrame([(1,), (1,), (None,), (4,)], "k bigint")
    cfg = GenConfig("retail", counts={"products": 4}, keys={"products": keys})
    for chunk, n in ((common.CHUNK, 4 * 1500), (1100, 4 * 1500), (common.CHUNK, 4 * 1500 - 3)):
        monkeypatch.setattr(common, "CHUNK", chunk)
        df = common.positions(spark, cfg, "products", n, split=True)
        assert _text(df).count("Generate explode(sequence") == 1 and "slice" in _text(df)
        got = sorted((r.id, r._share, r._place) for r in df.collect())
        assert got == sorted((1500 * s + p, s, p) for s in (0, 0, 3) for p in range(1500) if 1500 * s + p < n)
    plain = common.positions(spark, cfg.with_(keys={}), "products", 4 * 30, split=True)
    assert sorted((r.id, r._share, r._place) for r in plain.collect()) == [(i, i // 30, i % 30) for i in range(120)]


def test_huge_tables_have_a_bounded_number_of_tasks(spark):
    from wareloom.operators import ranking

    assert ranking.tasks_for(spark, 72_000_000_000) == 9000
    assert ranking.tasks_for(spark, 2_592_000_000_000) == ranking.MOST_TASKS
    assert ranking.tasks_for(spark, 72_000_000_000, ranking.WIDE_TASK_ROWS) == 72_000
