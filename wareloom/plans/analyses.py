"""The analyses the report names, one DataFrame query each.

Facts are summed per foreign key before they meet a dimension. Windows run over
rows that are already bounded (calendar months, plan steps of one customer); wider
ranks use ``value_rank``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wareloom.operators.ranking import ntile_of, value_rank
from wareloom.operators.rounds import in_rounds
from wareloom.operators.validate import iqr_bounds

Tables = dict[str, DataFrame]


def _n() -> Column:
    return F.count(F.lit(1))


def _dec(c) -> Column:
    return F.sum(c).cast("decimal(38,2)")


def _ratio(a: Column, b: Column) -> Column:
    """a / b as a double, NULL when b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def _days(t: Tables, *cols: str | Column) -> DataFrame:
    return t["dim_date"].select("date_key", *cols)


# --- retail ---------------------------------------------------------------------

def sales_trends(t: Tables) -> DataFrame:
    """Revenue per day, ISO week (its Monday) and month."""
    daily = t["fact_sales"].groupBy("date_key").agg(_dec("revenue").alias("revenue"), _n().alias("n"))
    d = F.col("full_date")
    periods = F.array(
        F.struct(F.lit("day").alias("grain"), d.cast("string").alias("period")),
        F.struct(F.lit("week").alias("grain"), F.coalesce(F.trunc(d, "week").cast("string"), F.lit("")).alias("period")),
        F.struct(F.lit("month").alias("grain"), F.date_format(d, "yyyy-MM").alias("period")),
    )
    return (
        daily.join(_days(t, "full_date"), "date_key")
        .select("revenue", "n", F.inline(periods))
        .groupBy("grain", "period")
        .agg(_dec("revenue").alias("revenue"), F.sum("n").alias("n_sales"))
    )


def store_performance(t: Tables) -> DataFrame:
    sold = t["fact_sales"].groupBy("store_key").agg(_dec("revenue").alias("revenue"), _n().alias("n_sales"))
    stores = t["dim_store"].select("store_key", "region")
    ranked = value_rank(sold.join(stores, "store_key"), "revenue", ["store_key"], ["region"], kind="rank")
    return ranked.withColumnRenamed("_rank", "rank_in_region").drop("_n")


def customer_segments(t: Tables) -> DataFrame:
    """Recency, frequency and value per customer with fifths of each, beside the tier."""
    last_day = t["dim_date"].agg(F.max("date_key")).scalar()
    rfm = t["fact_sales"].groupBy("customer_key").agg(
        (last_day - F.max("date_key")).alias("recency_days"), _n().alias("frequency"), _dec("revenue").alias("monetary")
    )
    scores = _metric_ranks(
        rfm, "customer_key", {"r": -F.col("recency_days"), "f": F.col("frequency"), "m": F.col("monetary")},
        ["recency_days", "frequency", "monetary"],
    ).select(
        "customer_key", "recency_days", "frequency", "monetary",
        *[ntile_of(F.col(f"{m}_rank"), F.col("_n"), 5).alias(f"{m}_score") for m in "rfm"],
    )
    return scores.join(t["dim_customer"].select("customer_key", "loyalty_tier"), "customer_key")


def _metric_ranks(df: DataFrame, key: str, metrics: dict[str, Column], keep: list[str], kind: str = "row_number") -> DataFrame:
    """Ascending rank ``<name>_rank`` of several metrics of one entity, and the count ``_n``.

    The metrics are stacked, ranked as groups of one ranking and folded back per
    entity, so the table is read as often as for a single rank.
    """
    value = {m: c.cast("decimal(38,2)") for m, c in metrics.items()}
    stacked = df.select(key, *keep, F.inline(F.array(*[
        F.struct(F.lit(m).alias("_metric"), F.coalesce(c, F.lit(0).cast("decimal(38,2)")).alias("_value")) for m, c in value.items()
    ])))
    ranked = value_rank(stacked, "_value", [key], ["_metric"], kind=kind, descending=False)
    return ranked.groupBy(key).agg(
        *[F.first(c).alias(c) for c in keep], F.max("_n").alias("_n"),
        *[F.max(F.when(F.col("_metric") == m, F.col("_rank"))).alias(f"{m}_rank") for m in metrics],
    )


def stock_turnover(t: Tables) -> DataFrame:
    """Units sold per unit in stock, and whether that beats the overall turnover."""
    sold = t["fact_sales"].groupBy("product_key").agg(F.sum("quantity").alias("sold"))
    stock = t["fact_inventory"].groupBy("product_key").agg(F.sum("stock_on_hand").alias("stock"))
    both = stock.join(sold, "product_key", "left").fillna(0, ["sold"])
    overall = both.agg(_ratio(F.sum("sold"), F.sum("stock"))).scalar()
    turnover = _ratio(F.col("sold"), F.col("stock"))
    return both.withColumn("turnover", turnover).withColumn(
        "mover", F.when(F.col("turnover") >= overall, "fast").otherwise("slow")
    )


def seasonality(t: Tables) -> DataFrame:
    """Revenue index per category and calendar month: 1 is the category's mean month."""
    months = [str(m) for m in range(1, 13)]
    per = t["fact_sales"].groupBy("product_key", "date_key").agg(_dec("revenue").alias("revenue"))
    per = per.join(_days(t, "month"), "date_key").groupBy("product_key", "month").agg(_dec("revenue").alias("revenue"))
    wide = (
        per.join(t["dim_product"].select("product_key", "category"), "product_key")
        .groupBy("category").pivot("month", list(range(1, 13))).agg(_dec("revenue"))
    )
    zero = F.lit(0).cast("decimal(38,2)")
    total = zero
    for m in months:
        total = total + F.coalesce(F.col(m), zero)
    wide = wide.withColumn("_total", total.cast("double"))
    return wide.select(
        "category", *[(F.coalesce(F.col(m), zero).cast("double") * 12 / F.col("_total")).alias(f"m{m}") for m in months]
    )


# --- e-commerce -----------------------------------------------------------------

STAGES = ["page_view", "product_view", "add_to_cart", "checkout_start", "purchase"]


def conversion_funnel(t: Tables) -> DataFrame:
    """Customers per stage and their share of the stage before."""
    seen = t["fact_web_events"].where(F.col("event_type").isin(STAGES)).groupBy("event_type", "customer_key").agg(
        _n().alias("n")
    )
    stages = seen.groupBy(F.col("event_type").alias("stage")).agg(
        _n().alias("n_customers"), F.sum("n").alias("n_events")
    )
    no = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")).cast("int")
    w = W.orderBy("stage_no")  # one row per stage
    return stages.withColumn("stage_no", no).withColumn(
        "step_rate", _ratio(F.col("n_customers"), F.lag("n_customers").over(w))
    )


def acquisition_channels(t: Tables) -> DataFrame:
    orders = t["fact_orders"].groupBy("customer_key").agg(_n().alias("n"), _dec("order_value").alias("gmv"))
    customers = t["dim_customer"].select("customer_key", "acquisition_channel")
    return customers.join(orders, "customer_key", "left").groupBy("acquisition_channel").agg(
        _n().alias("n_customers"),
        F.sum(F.coalesce("n", F.lit(0))).alias("n_orders"),
        _dec("gmv").alias("gmv"),
    )


def cart_abandonment(t: Tables) -> DataFrame:
    """Sessions with something in the cart and no purchase."""
    event = F.col("event_type")
    sessions = t["fact_web_events"].where(event.isin("add_to_cart", "purchase")).groupBy("session_id").agg(
        F.max(event == "add_to_cart").alias("cart"), F.max(event == "purchase").alias("bought")
    )
    return sessions.where("cart").agg(
        _n().alias("cart_sessions"),
        F.coalesce(F.sum((~F.col("bought")).cast("bigint")), F.lit(0)).alias("abandoned"),
    ).withColumn("abandon_rate", _ratio(F.col("abandoned"), F.col("cart_sessions")))


def bought_together(t: Tables) -> DataFrame:
    """Product pairs of the same order with their support and lift.

    An order has at most five lines, so it adds at most ten pairs.
    """
    items = t["fact_order_items"].select("order_id", "product_key").distinct()
    n_orders = items.agg(F.countDistinct("order_id")).scalar()
    single = items.groupBy("product_key").agg(_n().alias("n"))
    a, b = items.withColumnRenamed("product_key", "product_a"), items.withColumnRenamed("product_key", "product_b")
    pairs = (
        a.join(b, "order_id").where(F.col("product_a") < F.col("product_b"))
        .groupBy("product_a", "product_b").agg(_n().alias("n_orders"))
    )
    return (
        pairs.join(single.select(F.col("product_key").alias("product_a"), F.col("n").alias("na")), "product_a")
        .join(single.select(F.col("product_key").alias("product_b"), F.col("n").alias("nb")), "product_b")
        .select(
            "product_a", "product_b", "n_orders",
            (F.col("n_orders").cast("double") * n_orders / (F.col("na") * F.col("nb"))).alias("lift"),
        )
    )


def cohort_value(t: Tables) -> DataFrame:
    """Cumulative order value per signup month and order month."""
    orders = t["fact_orders"].groupBy("customer_key", "date_key").agg(_dec("order_value").alias("gmv"))
    orders = orders.join(_days(t, "full_date"), "date_key")
    per = orders.groupBy("customer_key", F.date_format("full_date", "yyyy-MM").alias("order_month")).agg(
        _dec("gmv").alias("gmv")
    )
    cohort = t["dim_customer"].select("customer_key", F.date_format("signup_date", "yyyy-MM").alias("cohort"))
    cells = per.join(cohort, "customer_key").groupBy("cohort", "order_month").agg(
        _dec("gmv").alias("gmv"), _n().alias("n_customers")
    )
    w = W.partitionBy("cohort").orderBy("order_month").rowsBetween(W.unboundedPreceding, W.currentRow)
    return cells.withColumn("cum_gmv", F.sum("gmv").over(w).cast("decimal(38,2)"))


# --- banking --------------------------------------------------------------------

def unusual_transactions(t: Tables, z_hundredths: int = 170) -> DataFrame:
    """Transactions more than z population deviations from their account's mean.

    Count, sum and sum of squares per account are exact integers; the comparison is
    squared, so no rounding decides. The statistics are joined back instead of
    computed over a window, which lets the engine split an account that is too large.
    """
    txns = t["fact_transactions"].select(
        "transaction_id", "account_key", "amount", (F.col("amount") * 100).cast("bigint").alias("_c")
    )
    c = F.col("_c").cast("decimal(19,0)")
    stats = txns.groupBy("account_key").agg(
        _n().alias("_n"), F.sum("_c").alias("_s"), F.sum(c * c).cast("decimal(38,0)").alias("_q")
    )
    n, s = F.col("_n").cast("decimal(19,0)"), F.col("_s").cast("decimal(19,0)")
    gap = (F.col("_c") * F.col("_n") - F.col("_s")).cast("decimal(18,0)")
    spread = n * F.col("_q") - s * s
    return txns.join(stats, "account_key").where(
        gap * gap * F.lit(10000) > spread * F.lit(z_hundredths**2)
    ).select("transaction_id", "account_key", "amount")


def transaction_bursts(t: Tables, at_least: int = 2) -> DataFrame:
    """Accounts with several transactions on one day, and at how many branches."""
    return (
        t["fact_transactions"].groupBy("account_key", "date_key")
        .agg(_n().alias("n_txns"), F.countDistinct("branch_key").alias("n_branches"))
        .where(F.col("n_txns") >= at_least)
    )


def default_rates(t: Tables) -> DataFrame:
    loans = t["fact_loans"].groupBy("customer_key").agg(
        _n().alias("n"), F.sum((F.col("status") == "Default").cast("bigint")).alias("bad"),
        _dec("principal").alias("principal"),
    )
    return (
        loans.join(t["dim_customer"].select("customer_key", "segment"), "customer_key")
        .groupBy("segment")
        .agg(F.sum("n").alias("n_loans"), F.sum("bad").alias("n_defaults"), _dec("principal").alias("principal"))
        .withColumn("default_rate", _ratio(F.col("n_defaults"), F.col("n_loans")))
    )


def branch_volume(t: Tables) -> DataFrame:
    volume = t["fact_transactions"].groupBy("branch_key").agg(
        _n().alias("n_txns"), _dec(F.abs("amount")).alias("volume"), _dec("amount").alias("net_flow")
    )
    return volume.join(t["dim_branch"].select("branch_key", "branch_name", "region"), "branch_key")


TXN_TYPES = ["Deposit", "Withdrawal", "Transfer", "Payment", "Fee", "Interest"]


def customer_behaviour(t: Tables) -> DataFrame:
    """Transactions per customer and type."""
    per_account = t["fact_transactions"].groupBy("account_key", "transaction_type").agg(_n().alias("n"))
    wide = (
        per_account.join(t["dim_account"].select("account_key", "customer_key"), "account_key")
        .groupBy("customer_key").pivot("transaction_type", TXN_TYPES).agg(F.sum("n"))
        .fillna(0)
    )
    return wide.select("customer_key", *[F.col(c).alias(f"n_{c.lower()}") for c in TXN_TYPES])


def portfolio_health(t: Tables) -> DataFrame:
    """Loans per type and status with all subtotals."""
    return t["fact_loans"].groupingSets(
        [["loan_type", "status"], ["loan_type"], ["status"], []], "loan_type", "status"
    ).agg(_n().alias("n_loans"), _dec("principal").alias("principal"), _dec("monthly_payment").alias("monthly_payment"))


# --- healthcare -----------------------------------------------------------------

def utilisation(t: Tables) -> DataFrame:
    per_day = t["fact_encounters"].groupBy("visit_type", "date_key").agg(_n().alias("n"))
    return per_day.join(_days(t, "year", "month"), "date_key").groupBy("visit_type", "year", "month").agg(
        F.sum("n").alias("n_encounters")
    )


def cost_cube(t: Tables) -> DataFrame:
    """Procedure charges by diagnosis and procedure with all subtotals."""
    enc = t["fact_encounters"].select("encounter_id", "diagnosis_key")
    cells = t["fact_procedures"].join(enc, "encounter_id").groupBy("diagnosis_key", "cpt_code").agg(
        _n().alias("n"), _dec("charge_amount").alias("charges")
    )
    named = cells.join(t["dim_diagnosis"].select("diagnosis_key", "icd10_code"), "diagnosis_key")
    return named.cube("icd10_code", "cpt_code").agg(F.sum("n").alias("n_procedures"), _dec("charges").alias("charges"))


def length_of_stay(t: Tables) -> DataFrame:
    """Mean stay per month of admitted patients, and stays outside the quartile fences."""
    stays = t["fact_encounters"].where(F.col("length_of_stay") > 0)
    high = iqr_bounds(stays, "length_of_stay", k=0.25).select("high").scalar()
    per_day = stays.groupBy("date_key").agg(
        _n().alias("n"), F.sum("length_of_stay").alias("days"),
        F.sum((F.col("length_of_stay") > high).cast("bigint")).alias("long"),
    )
    return per_day.join(_days(t, "year", "month"), "date_key").groupBy("year", "month").agg(
        F.sum("n").alias("n_stays"), F.sum("long").alias("n_outliers"), _ratio(F.sum("days"), F.sum("n")).alias("avg_stay")
    )


def doctor_productivity(t: Tables) -> DataFrame:
    seen = t["fact_encounters"].groupBy("doctor_key").agg(_n().alias("n_encounters"), _dec("total_charges").alias("charges"))
    named = seen.join(t["dim_doctor"].select("doctor_key", "specialty"), "doctor_key")
    ranked = value_rank(named, "n_encounters", ["doctor_key"], ["specialty"], kind="dense_rank")
    return ranked.withColumnRenamed("_rank", "rank_in_specialty").drop("_n")


def denial_rates(t: Tables) -> DataFrame:
    """Denied claims per insurance type."""
    claims = t["fact_billing"].select("encounter_id", (F.col("claim_status") == "Denied").cast("bigint").alias("_denied"))
    per_patient = claims.join(t["fact_encounters"].select("encounter_id", "patient_key"), "encounter_id").groupBy(
        "patient_key"
    ).agg(_n().alias("n"), F.sum("_denied").alias("denied"))
    return (
        per_patient.join(t["dim_patient"].select("patient_key", "insurance_type"), "patient_key")
        .groupBy("insurance_type").agg(F.sum("n").alias("n_claims"), F.sum("denied").alias("n_denied"))
        .withColumn("denial_rate", _ratio(F.col("n_denied"), F.col("n_claims")))
    )


# --- SaaS -----------------------------------------------------------------------

def _active_months(t: Tables) -> DataFrame:
    subs = t["fact_subscriptions"].where(F.col("status") == "Active").withColumnRenamed("snapshot_date_key", "date_key")
    return subs.join(_days(t, "full_date"), "date_key")


def mrr_growth(t: Tables) -> DataFrame:
    monthly = t["fact_subscriptions"].where(F.col("status") == "Active").groupBy(
        F.col("snapshot_date_key").alias("date_key")
    ).agg(_dec("mrr").alias("mrr"))
    w = W.orderBy("full_date")  # one row per month
    return monthly.join(_days(t, "full_date"), "date_key").select(
        "full_date", "mrr", F.lag("mrr").over(w).alias("prev_mrr")
    ).withColumn("growth", _ratio(F.col("mrr") - F.col("prev_mrr"), F.col("prev_mrr")))


def churn_reasons(t: Tables) -> DataFrame:
    return t["fact_churn"].groupBy("reason").agg(
        _n().alias("n_churned"), _dec("mrr_lost").alias("mrr_lost"),
        _ratio(F.sum("tenure_months"), _n()).alias("avg_tenure"),
    )


def _monthly_usage(usage: DataFrame, days: DataFrame) -> DataFrame:
    """(customer_key, month, calls), a customer's rows in one task.

    Days turn into months beside the fact (the calendar is bounded), and the uses themselves go to their customer's task once, where
    the months and whatever is partitioned by customer follow without another shuffle. Sums before the shuffle would hold
    nearly as many groups as there are uses.
    """
    uses = usage.join(F.broadcast(days), "date_key").select("customer_key", "_month", "api_calls")
    monthly = uses.repartition("customer_key").groupBy("customer_key", "_month").agg(F.sum("api_calls").alias("calls"))
    return monthly.select("customer_key", F.date_format("_month", "yyyy-MM").alias("month"), "calls")


def customers_at_risk(t: Tables) -> DataFrame:
    """Months in which a customer's calls fell below half of the month with use before."""
    w = W.partitionBy("customer_key").orderBy("month")  # at most 61 months per customer
    days = _days(t, F.trunc("full_date", "month").alias("_month"))
    return in_rounds(t["fact_usage"], "customer_key", lambda usage: _monthly_usage(usage, days).withColumn(
        "prev_calls", F.lag("calls").over(w)).where(F.col("calls") * 2 < F.col("prev_calls")))


def retention(t: Tables) -> DataFrame:
    """Active customers per signup month and age in months."""
    active = _active_months(t).select("customer_key", "full_date")
    joined = active.join(t["dim_customer"].select("customer_key", "signup_date"), "customer_key")
    age = (F.year("full_date") - F.year("signup_date")) * 12 + F.month("full_date") - F.month("signup_date")
    return joined.groupBy(F.date_format("signup_date", "yyyy-MM").alias("cohort"), age.alias("age_months")).agg(
        F.countDistinct("customer_key").alias("n_customers")
    )


def usage_vs_upgrades(t: Tables) -> DataFrame:
    """Correlation of total API calls with the number of plan upgrades per customer."""
    w = W.partitionBy("customer_key").orderBy("snapshot_date_key")  # at most 60 snapshots per customer
    ups = (
        t["fact_subscriptions"].withColumn("_prev", F.lag("plan_key").over(w))
        .groupBy("customer_key").agg(F.sum((F.col("plan_key") > F.col("_prev")).cast("bigint")).alias("y"))
    )
    calls = t["fact_usage"].groupBy("customer_key").agg(F.sum("api_calls").alias("x"))
    both = calls.join(ups.fillna(0, ["y"]), "customer_key").select(
        F.col("x").cast("decimal(18,0)").alias("x"), F.col("y").cast("decimal(18,0)").alias("y")
    )
    x, y = F.col("x"), F.col("y")
    s = both.agg(
        _n().alias("n_customers"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    n, sx, sy = (F.col(c).cast("double") for c in ("n_customers", "sx", "sy"))
    sxx, syy, sxy = (F.col(c).cast("double") for c in ("sxx", "syy", "sxy"))
    spread = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return s.select("n_customers", F.round(_ratio(n * sxy - sx * sy, spread), 6).alias("correlation"))


def health_scores(t: Tables) -> DataFrame:
    """Mix of the percent ranks of logins, calls and feature variety, from 0 to 100."""
    per = t["fact_usage"].groupBy("customer_key").agg(
        F.sum("logins").alias("logins"), F.sum("api_calls").alias("calls"), F.countDistinct("feature").alias("features")
    )
    measures = ["logins", "calls", "features"]
    ranked = _metric_ranks(per, "customer_key", {m: F.col(m) for m in measures}, measures, kind="rank")
    score = F.lit(0.0)
    for m, weight in zip(measures, (50, 30, 20)):
        score = score + F.coalesce(_ratio((F.col(f"{m}_rank") - 1) * weight, F.col("_n") - 1), F.lit(0.0))
    return ranked.select("customer_key", *measures, score.alias("health_score"))


# --- logistics ------------------------------------------------------------------

def ontime_by_month(t: Tables) -> DataFrame:
    d = t["fact_deliveries"].where(F.col("delivery_status") == "Delivered").select("shipment_id", "on_time")
    per_day = t["fact_shipments"].select("shipment_id", "date_key").join(d, "shipment_id").groupBy("date_key").agg(
        _n().alias("n"), F.sum(F.col("on_time").cast("bigint")).alias("ok")
    )
    return per_day.join(_days(t, "year", "month"), "date_key").groupBy("year", "month").agg(
        F.sum("n").alias("n_delivered"), _ratio(F.sum("ok") * 100, F.sum("n")).alias("on_time_pct")
    )


def efficient_routes(t: Tables) -> DataFrame:
    """Cost per mile per route, ranked among the routes of the same city pair."""
    used = t["fact_shipments"].groupBy("route_key").agg(
        _ratio(F.sum("shipping_cost"), F.sum("distance_miles")).alias("cost_per_mile"), _n().alias("n_shipments")
    )
    named = used.join(t["dim_route"].select("route_key", "origin_city", "destination_city"), "route_key")
    ranked = value_rank(
        named, "cost_per_mile", ["route_key"], ["origin_city", "destination_city"], kind="rank", descending=False
    )
    return ranked.withColumnRenamed("_rank", "rank_in_pair").drop("_n")


def fleet_utilisation(t: Tables) -> DataFrame:
    days = t["dim_date"].agg(_n()).scalar()
    return t["fact_fleet_usage"].groupBy("vehicle_key").agg(
        F.countDistinct("date_key").alias("active_days"), F.sum("miles_driven").alias("miles")
    ).withColumn("utilisation", _ratio(F.col("active_days"), days))


def cost_per_mile(t: Tables) -> DataFrame:
    used = t["fact_shipments"].groupBy("route_key").agg(
        _dec("shipping_cost").alias("cost"), F.sum("distance_miles").alias("miles")
    )
    return used.join(t["dim_route"].select("route_key", "route_type"), "route_key").groupBy("route_type").agg(
        _dec("cost").alias("total_cost"), F.sum("miles").alias("total_miles"),
        _ratio(F.sum("cost"), F.sum("miles")).alias("cost_per_mile"),
    )


def warehouse_throughput(t: Tables) -> DataFrame:
    """Shipments and weight leaving and reaching each warehouse."""
    moves = F.array(
        F.struct(F.col("origin_warehouse_key").alias("warehouse_key"), F.lit(1).alias("out_"), F.lit(0).alias("in_")),
        F.struct(F.col("dest_warehouse_key").alias("warehouse_key"), F.lit(0).alias("out_"), F.lit(1).alias("in_")),
    )
    return t["fact_shipments"].select("weight_lbs", F.inline(moves)).groupBy("warehouse_key").agg(
        F.sum("out_").alias("n_outbound"), F.sum("in_").alias("n_inbound"), F.sum("weight_lbs").alias("weight_lbs")
    )


# name -> (industry, tables read, function)
ANALYSES = {
    "ana_retail_trends": ("retail", ["fact_sales", "dim_date"], sales_trends),
    "ana_retail_stores": ("retail", ["fact_sales", "dim_store"], store_performance),
    "ana_retail_segments": ("retail", ["fact_sales", "dim_customer", "dim_date"], customer_segments),
    "ana_retail_turnover": ("retail", ["fact_sales", "fact_inventory"], stock_turnover),
    "ana_retail_seasonality": ("retail", ["fact_sales", "dim_product", "dim_date"], seasonality),
    "ana_ecom_funnel": ("ecommerce", ["fact_web_events"], conversion_funnel),
    "ana_ecom_channels": ("ecommerce", ["fact_orders", "dim_customer"], acquisition_channels),
    "ana_ecom_abandonment": ("ecommerce", ["fact_web_events"], cart_abandonment),
    "ana_ecom_affinity": ("ecommerce", ["fact_order_items"], bought_together),
    "ana_ecom_ltv": ("ecommerce", ["fact_orders", "dim_customer", "dim_date"], cohort_value),
    "ana_bank_unusual": ("banking", ["fact_transactions"], unusual_transactions),
    "ana_bank_bursts": ("banking", ["fact_transactions"], transaction_bursts),
    "ana_bank_defaults": ("banking", ["fact_loans", "dim_customer"], default_rates),
    "ana_bank_branches": ("banking", ["fact_transactions", "dim_branch"], branch_volume),
    "ana_bank_behaviour": ("banking", ["fact_transactions", "dim_account"], customer_behaviour),
    "ana_bank_portfolio": ("banking", ["fact_loans"], portfolio_health),
    "ana_health_utilisation": ("healthcare", ["fact_encounters", "dim_date"], utilisation),
    "ana_health_cost_cube": ("healthcare", ["fact_encounters", "fact_procedures", "dim_diagnosis"], cost_cube),
    "ana_health_stay": ("healthcare", ["fact_encounters", "dim_date"], length_of_stay),
    "ana_health_doctors": ("healthcare", ["fact_encounters", "dim_doctor"], doctor_productivity),
    "ana_health_denials": ("healthcare", ["fact_billing", "fact_encounters", "dim_patient"], denial_rates),
    "ana_saas_growth": ("saas", ["fact_subscriptions", "dim_date"], mrr_growth),
    "ana_saas_churn": ("saas", ["fact_churn"], churn_reasons),
    "ana_saas_at_risk": ("saas", ["fact_usage", "dim_date"], customers_at_risk),
    "ana_saas_retention": ("saas", ["fact_subscriptions", "dim_customer", "dim_date"], retention),
    "ana_saas_upgrades": ("saas", ["fact_subscriptions", "fact_usage"], usage_vs_upgrades),
    "ana_saas_health": ("saas", ["fact_usage"], health_scores),
    "ana_logi_ontime": ("logistics", ["fact_shipments", "fact_deliveries", "dim_date"], ontime_by_month),
    "ana_logi_routes": ("logistics", ["fact_shipments", "dim_route"], efficient_routes),
    "ana_logi_fleet": ("logistics", ["fact_fleet_usage", "dim_date"], fleet_utilisation),
    "ana_logi_cost_per_mile": ("logistics", ["fact_shipments", "dim_route"], cost_per_mile),
    "ana_logi_throughput": ("logistics", ["fact_shipments"], warehouse_throughput),
}
