"""Named queries over a folder of Parquet tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.operators import clean, identity, profile, quality, validate
from wareloom import report
from wareloom.functions.draws import (
    Draws, distinct_pair, growth_count, key_draw, money, padded_id, quarter_label,
)
from wareloom.operators.ranking import sample_rows
from wareloom.plans import analyses, dataset, kpis, scaled, sqlpack
from wareloom.plans.model import KEYS
from wareloom.plans.scaled import load

Query = Callable[[SparkSession, str], DataFrame]

# Dimensions of fixed content are registered with their use in a fact table.
FIXED_DIMS = {
    ("ecommerce", "dim_channel"): ("fact_orders", "channel_key", "channel_key", "n_orders"),
    ("healthcare", "dim_diagnosis"): ("fact_encounters", "diagnosis_key", "diagnosis_key", "n_encounters"),
    ("saas", "dim_plan"): ("fact_subscriptions", "plan_key", "plan_key", "n_snapshots"),
}


def _generated(industry: str, table: str) -> Query:
    def query(spark, folder):
        return dataset.table(spark, scaled.config(spark, folder, industry), table)

    return query


def _fixed_dim(industry: str, table: str) -> Query:
    fact, fk, key, name = FIXED_DIMS[industry, table]

    def query(spark, folder):
        cfg = scaled.config(spark, folder, industry)
        use = dataset.table(spark, cfg, fact).groupBy(F.col(fk).alias(key)).agg(F.count(F.lit(1)).alias(name))
        return dataset.table(spark, cfg, table).join(use, key, "left")

    return query


def generated_queries() -> dict[str, Query]:
    out = {}
    for industry, tables in dataset.GENERATORS.items():
        for table in tables:
            if (industry, table) in FIXED_DIMS:
                out[f"gen_{industry}_{table}"] = _fixed_dim(industry, table)
            # Calendars follow from the configuration alone, and saas.dim_product is five literal rows that no
            # fact refers to: both are library tables, not queries over given ones.
            elif table != "dim_date" and (industry, table) != ("saas", "dim_product"):
                out[f"gen_{industry}_{table}"] = _generated(industry, table)
    return out


# --- noise on the given tables ------------------------------------------------

SEED = 42
RATE = 0.10        # the heavy quality level
HIGH_RATE = 0.50   # the largest rate, which also reaches the cap of the null rule
CUSTOMER_KEYS = ("c_custkey", "c_nationkey")
PART_KEYS = ("p_partkey",)
ORDER_KEYS = ("o_orderkey", "o_custkey")
LINE_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _noise(key: str, protected, rate=RATE, copy=None) -> quality.Noise:
    return quality.Noise(SEED, rate, key, protected, copy)


def _apply(noise: quality.Noise, df: DataFrame, *steps) -> DataFrame:
    df = noise.attach(df)
    for step in steps:
        df = step(df)
    return noise.detach(df)


def q_case(spark, folder):
    n = _noise("c_custkey", CUSTOMER_KEYS, HIGH_RATE)
    return _apply(n, load(spark, folder, "customer"), n.case)


def q_typo(spark, folder):
    n = _noise("p_partkey", PART_KEYS, HIGH_RATE)
    return _apply(n, load(spark, folder, "part"), n.typos)


def q_whitespace(spark, folder):
    n = _noise("p_partkey", PART_KEYS, HIGH_RATE)
    return _apply(n, load(spark, folder, "part"), n.whitespace)


def _customer_countries(spark, folder):
    """Customers with a country: the first three nations take the names the rule knows."""
    nation = load(spark, folder, "nation").select(
        "n_nationkey",
        F.when(F.col("n_nationkey") == 0, "USA").when(F.col("n_nationkey") == 1, "UK")
        .when(F.col("n_nationkey") == 2, "Canada").otherwise(F.col("n_name")).alias("country"),
    )
    customer = load(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", "country")


def q_country(spark, folder):
    n = _noise("c_custkey", CUSTOMER_KEYS, HIGH_RATE)
    return _apply(n, _customer_countries(spark, folder), n.country)


def q_duplicates(spark, folder):
    n = scaled.extent(spark, folder).counts["orders"]
    return quality.inject_duplicates(load(spark, folder, "orders"), HIGH_RATE, SEED, "o_orderkey", n, first_key=0)


def q_duplicates_sparse_key(spark, folder):
    """A unique but not dense key: events are numbered in hash order first."""
    events = load(spark, folder, "events")
    return quality.inject_duplicates(events, HIGH_RATE, SEED, "event_id", events.count(), dense=False)


def _dirty_lineitem(spark, folder, rate=HIGH_RATE):
    df = identity.identify(load(spark, folder, "lineitem"), SEED).drop("_print", "_dup_no")
    n = _noise("_row_key", LINE_KEYS, rate)
    return _apply(n, df, n.negative_quantities).drop("_row_key")


def q_negative_qty(spark, folder):
    return _dirty_lineitem(spark, folder)


def q_amount_error(spark, folder):
    n = _noise("o_orderkey", ORDER_KEYS, HIGH_RATE)
    return _apply(n, load(spark, folder, "orders"), n.amount_errors)


def q_nulls(spark, folder):
    n = _noise("c_custkey", CUSTOMER_KEYS, HIGH_RATE)
    return _apply(n, load(spark, folder, "customer"), lambda df: n.nulls(df, True))


def q_nulls_fact(spark, folder):
    n = _noise("o_orderkey", ORDER_KEYS, HIGH_RATE)
    return _apply(n, load(spark, folder, "orders"), lambda df: n.nulls(df, False))


def q_inject_dim(spark, folder, rate=RATE):
    return quality.inject_dimension(load(spark, folder, "customer"), rate, SEED, "c_custkey", CUSTOMER_KEYS)


def q_inject_fact(spark, folder, rate=RATE):
    n = scaled.extent(spark, folder).counts["orders"]
    return quality.inject_fact(
        load(spark, folder, "orders"), rate, SEED, "o_orderkey", n, ORDER_KEYS, first_key=0, keep_copy_no=True
    )


def q_inject_fact_keyless(spark, folder):
    """Line items have no key: identity by content and copy number, then as usual."""
    n = scaled.extent(spark, folder).counts["lineitem"]
    df = identity.identify(load(spark, folder, "lineitem"), SEED).drop("_print", "_dup_no")
    out = quality.inject_fact(df, RATE, SEED, "_row_key", n, LINE_KEYS, dense=False, keep_copy_no=True)
    return out.drop("_row_key")


def q_inject_sales(spark, folder):
    cfg = scaled.config(spark, folder, "retail", quality="heavy")
    return quality.inject_fact(
        dataset.table(spark, cfg, "fact_sales"), cfg.quality_rate, cfg.seed, "sale_id", cfg.n("transactions")
    )


def q_date_formats(spark, folder):
    orders = load(spark, folder, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").cast("string").alias("order_date")
    )
    n = _noise("o_orderkey", ORDER_KEYS)
    return _apply(n, orders, lambda df: n.date_formats(df, ["order_date"]))


def _order_ship_dates(spark, folder):
    """Orders with the date of their first shipment, as ISO text."""
    ship = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min(F.to_date("l_shipdate")).cast("string").alias("ship_date")
    )
    orders = load(spark, folder, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").cast("string").alias("order_date")
    )
    return orders.join(ship, "o_orderkey", "left")


def l_time_travel(spark, folder):
    return quality.inject_time_travelers(
        _order_ship_dates(spark, folder), "order_date", "ship_date", "o_orderkey", rate=0.2, seed=SEED
    )


def l_orphans(spark, folder, rate=0.02):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return quality.inject_orphans(orders, "o_custkey", "o_orderkey", rate=rate, seed=SEED)


# --- cleaning -------------------------------------------------------------------

def clean_text(spark, folder):
    n = _noise("c_custkey", CUSTOMER_KEYS, HIGH_RATE)
    df = _apply(n, load(spark, folder, "customer"), lambda df: n.apply(df, n._case, n._space))
    return clean.clean_text(df, ["c_name", "c_mktsegment"])


def clean_country(spark, folder):
    return clean.clean_country(q_country(spark, folder))


def clean_nulls(spark, folder):
    return clean.impute(
        q_inject_dim(spark, folder, HIGH_RATE),
        {"c_name": ("UNKNOWN",), "c_mktsegment": "mode", "c_acctbal": "mean"},
    )


def clean_nulls_by_group(spark, folder):
    """Gaps of dirtied orders from the customer's other orders, and dates from the order before."""
    return clean.impute(q_nulls_fact(spark, folder), {
        "o_orderstatus": clean.By("mode", ("o_custkey",)), "o_totalprice": clean.By("median", ("o_custkey",)),
        "o_orderpriority": clean.By("mode", ("o_custkey",)), "o_orderdate": clean.Last(("o_orderkey",)),
    })


def clean_nulls_last_known(spark, folder):
    """The customer's last known status and total, by order key."""
    return clean.impute(q_nulls_fact(spark, folder), {
        "o_orderstatus": clean.Last(("o_orderkey",), ("o_custkey",)), "o_totalprice": clean.Last(("o_orderkey",), ("o_custkey",)),
        "o_orderdate": "median",
    })


def clean_dropna(spark, folder):
    return clean.drop_missing(q_inject_dim(spark, folder, HIGH_RATE), ["c_name", "c_mktsegment"])


def _dedupe(keep):
    def query(spark, folder):
        return clean.dedupe(q_inject_fact(spark, folder, HIGH_RATE), ["o_orderkey"], ["_copy_no"], keep)

    return query


def clean_negative_qty(spark, folder):
    return clean.fix_negative(_dirty_lineitem(spark, folder), ["l_quantity"])


# --- validation -----------------------------------------------------------------

def val_pk(spark, folder):
    return validate.duplicate_keys(load(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def val_fk(spark, folder):
    customer = load(spark, folder, "customer")
    return validate.orphan_keys(l_orphans(spark, folder), "o_custkey", customer, "c_custkey")


def val_fk_report(spark, folder):
    cfg = scaled.config(spark, folder, "ecommerce")
    tables = dataset.generate(spark, cfg)
    tables["fact_orders"] = quality.inject_orphans(
        tables["fact_orders"], "customer_key", "order_id", max_valid=cfg.n("customers"), seed=SEED
    )
    return validate.reference_report(tables, KEYS["ecommerce"])


def val_calc(spark, folder):
    """Sales whose revenue does not follow from quantity, price and discount."""
    df = q_inject_sales(spark, folder)
    expected = (F.col("unit_price") * F.col("quantity") - F.col("discount")).cast("decimal(18,2)")
    return validate.wrong_totals(df, F.col("revenue"), expected)


def val_outliers(spark, folder):
    """Prices are spread evenly, so fences at 0.45 times the quartiles' distance leave out some 2.5 % at both ends."""
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return validate.outliers(lines, "l_extendedprice", k=0.45)


def val_outliers_by_supplier(spark, folder):
    """Lines priced outside the fences of their own supplier."""
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return validate.outliers(lines, "l_extendedprice", k=0.4, group=["l_suppkey"])


def val_fences_by_status(spark, folder):
    """Quartiles and fences of few, large groups."""
    lines = load(spark, folder, "lineitem")
    return validate.group_fences(lines, "l_extendedprice", ["l_returnflag", "l_linestatus"])


def val_distribution(spark, folder):
    """Line items and events against declared distributions; two of the declarations do not hold."""
    lines, events = load(spark, folder, "lineitem"), load(spark, folder, "events")
    discount = F.round(F.col("l_discount") * 100).cast("int")
    of_lines = validate.check_distributions(lines, {
        "return flag": (F.col("l_returnflag"), {"A": 1, "N": 1, "R": 1}),
        "line status": (F.col("l_linestatus"), {"F": 1, "O": 1}),
        "line number": (F.col("l_linenumber").cast("int"), {i: 1 for i in range(1, 8)}),
        "quantity": (F.col("l_quantity").cast("int"), {i: 1 for i in range(1, 51)}),
        "discount, half at both ends": (discount, {i: 1 if i in (0, 10) else 2 for i in range(11)}),
        "discount, all alike": (discount, {i: 1 for i in range(11)}),
    }, {"price, even from 900 to 105000": (F.col("l_extendedprice") - 900.0) / 104100.0})
    of_events = validate.check_distributions(
        events, {"event type": (F.col("event_type"), {"click": 1, "error": 1, "purchase": 1, "signup": 1, "view": 1})}, {
            "value, exponential around 50": F.lit(1.0) - F.exp(F.col("value") / -50.0), "value, even to 500": F.col("value") / 500.0,
        })
    return of_lines.unionByName(of_events)


def val_iqr(spark, folder):
    return validate.iqr_bounds(load(spark, folder, "orders"), "o_totalprice")


def val_rules(spark, folder):
    df = load(spark, folder, "lineitem").join(
        load(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return validate.check_rules(df, {
        "ships before it is ordered": F.col("l_shipdate") < F.col("o_orderdate"),
        "quantity not positive": F.col("l_quantity") <= 0,
        "discount outside 0..1": ~F.col("l_discount").between(0, 1),
        "unknown status": ~F.col("o_orderstatus").isin("O", "F", "P"),
        "line worth more than its order": F.col("l_extendedprice") > F.col("o_totalprice"),
        "return flag missing": F.col("l_returnflag").isNull(),
    })


# --- profiles -------------------------------------------------------------------

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _given(spark, folder):
    return {t: load(spark, folder, t) for t in GIVEN}


def rep_total_rows(spark, folder):
    return profile.total_rows(_given(spark, folder))


def rep_overview(spark, folder):
    return profile.overview(_given(spark, folder))


def rep_numeric_stats(spark, folder):
    return profile.numeric_stats(_given(spark, folder))


def rep_missing(spark, folder):
    return profile.missing(_given(spark, folder))


def rep_missing_dirty(spark, folder):
    return profile.missing({
        "customer": q_inject_dim(spark, folder, HIGH_RATE),
        "orders": q_inject_fact(spark, folder, HIGH_RATE).drop("_copy_no"),
    })


def _summary(industry):
    def query(spark, folder):
        cfg = scaled.config(spark, folder, industry)
        return profile.summary(dataset.generate(spark, cfg))

    return query


def _insights(industry):
    """The key figures of an industry as report rows."""
    def query(spark, folder):
        cfg = scaled.config(spark, folder, industry)
        needed = sorted({t for i, ts, _ in kpis.KPIS.values() if i == industry for t in ts})
        parts = report.insights({t: dataset.table(spark, cfg, t) for t in needed}, cfg)
        return validate.union_all(parts)

    return query


def _dirty_summary(industry):
    """Missing and spelled-out missing cells per table of a dirtied data set."""
    def query(spark, folder):
        cfg = scaled.config(spark, folder, industry, quality="heavy")
        return profile.missing(dataset.dirty(dataset.generate(spark, cfg), cfg))

    return query


def growth_curve(spark, folder):
    """Orders per month beside the volume that compound growth from the first month gives."""
    orders = load(spark, folder, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    first = orders.agg(F.min_by("n_orders", "month")).scalar()
    start = orders.agg(F.min("month")).scalar()
    months = F.months_between("month", start).cast("int")
    return orders.select("month", "n_orders", growth_count(first, 0.05, months).alias("expected_orders"))


def growth_dates(spark, folder):
    """Sales dates drawn along the growth curve (opt-in)."""
    cfg = scaled.config(spark, folder, "retail", growth_dates=True)
    return dataset.table(spark, cfg, "fact_sales").select("sale_id", "date_key")


def draw_skewed_keys(spark, folder):
    """How often each customer key is drawn for the orders, hot keys first served."""
    u = Draws(SEED, "draws")
    n = scaled.extent(spark, folder).counts["customer"]
    orders = u.attach(load(spark, folder, "orders").select("o_orderkey"), "o_orderkey")
    return orders.select(u.skewed_key("customer", n).alias("customer_key")).groupBy("customer_key").agg(
        F.count(F.lit(1)).alias("n_draws")
    )


def draw_sample(spark, folder):
    """Exactly a tenth of the orders, without replacement."""
    n = scaled.extent(spark, folder).counts["orders"]
    orders = load(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    drawn = orders.withColumn("_draw", key_draw(SEED, "sample", "o_orderkey"))
    return sample_rows(drawn, "_draw", ["o_orderkey"], n // 10, n).drop("_draw").withColumnRenamed("_rank", "position")


def draw_primitives(spark, folder):
    """The scalar draws side by side for every order."""
    u = Draws(SEED, "draws")
    d = u.attach(load(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    first, second = distinct_pair(u.index("first", 30), u.index("second", 29), 30)
    day = F.to_date("o_orderdate")
    return d.select(
        "o_orderkey",
        u.randint("int", -5, 5).alias("int_draw"),
        money(u.randint("money", 100, 99999)).alias("money_draw"),
        u.choice("choice", ["a", "b", "c"]).alias("choice_draw"),
        u.weighted("weighted", {"x": 70, "y": 20, "z": 10}).alias("weighted_draw"),
        u.chance("chance", 0.05).alias("chance_draw"),
        first.alias("pair_first"), second.alias("pair_second"),
        quarter_label(day).alias("quarter"),
        padded_id("ORD", F.col("o_orderkey"), 6).alias("order_label"),
    )


def _on_tables(industry, needed, function):
    def query(spark, folder):
        cfg = scaled.config(spark, folder, industry)
        return function({t: dataset.table(spark, cfg, t) for t in needed})

    return query


def _sql(name):
    industry, needed, _ = sqlpack.QUERIES[name]

    def query(spark, folder):
        cfg = scaled.config(spark, folder, industry)
        return sqlpack.run(spark, name, {t: dataset.table(spark, cfg, t) for t in needed})

    return query


def quality_queries() -> dict[str, Query]:
    named = [
        q_case, q_typo, q_whitespace, q_country, q_duplicates, q_duplicates_sparse_key, q_negative_qty,
        q_amount_error, q_nulls, q_nulls_fact, q_inject_dim, q_inject_fact, q_inject_fact_keyless, q_inject_sales,
        q_date_formats, l_time_travel, l_orphans,
        clean_text, clean_country, clean_nulls, clean_nulls_by_group, clean_nulls_last_known, clean_dropna, clean_negative_qty,
        val_pk, val_fk, val_fk_report, val_calc, val_outliers, val_outliers_by_supplier, val_fences_by_status, val_iqr, val_rules,
        val_distribution,
        rep_total_rows, rep_overview, rep_numeric_stats, rep_missing, rep_missing_dirty,
    ]
    out = {q.__name__: q for q in named}
    for keep in ("first", "last", "merge"):
        out["clean_dedupe" if keep == "first" else f"clean_dedupe_{keep}"] = _dedupe(keep)
    return out


def report_queries() -> dict[str, Query]:
    out = {name: _on_tables(*spec) for name, spec in kpis.KPIS.items()}
    out.update({name: _sql(name) for name in sqlpack.QUERIES})
    out.update({f"rep_insights_{industry}": _insights(industry) for industry in dataset.GENERATORS})
    out.update({f"dataset_dirty_{industry}": _dirty_summary(industry) for industry in dataset.GENERATORS})
    out.update({q.__name__: q for q in (growth_curve, growth_dates, draw_skewed_keys, draw_sample, draw_primitives)})
    out.update({f"dataset_summary_{industry}": _summary(industry) for industry in dataset.GENERATORS})
    return out


def analysis_queries() -> dict[str, Query]:
    return {name: _on_tables(*spec) for name, spec in analyses.ANALYSES.items()}


def all_queries() -> dict[str, Query]:
    return {**report_queries(), **analysis_queries(), **generated_queries(), **quality_queries()}
