"""Retail banking: accounts, transactions, loans and cards."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.config import GenConfig
from wareloom.functions.draws import money, padded_id
from wareloom.plans.common import city, date_key, dim_date, first_name, int_col, last_name, seeded, state

# Fixed values.
SEGMENTS = {"Mass": 60, "Affluent": 25, "Private": 10, "Business": 5}
ACCOUNT_TYPES = ["Checking", "Savings", "Money Market", "CD", "IRA"]
ACCOUNT_STATUS = {"Active": 85, "Dormant": 10, "Closed": 5}
BRANCH_REGIONS = ["Northeast", "Southeast", "Midwest", "Southwest", "West"]
TXN_TYPES = {"Deposit": 25, "Withdrawal": 20, "Transfer": 20, "Payment": 20, "Fee": 10, "Interest": 5}
OUTFLOWS = ["Withdrawal", "Payment", "Fee"]
TXN_CHANNELS = ["Branch", "ATM", "Online", "Mobile", "Wire"]
LOAN_TYPES = ["Mortgage", "Auto", "Personal", "Student", "Business"]
# Loan terms: principal in dollars, rate in 1/100 percent, months.
LOAN_TERMS = {
    "Mortgage": ((100000, 500000), (300, 700), [180, 240, 360]),
    "Auto": ((10000, 60000), (400, 1000), [36, 48, 60, 72]),
    None: ((5000, 50000), (600, 1800), [12, 24, 36, 48, 60]),
}
LOAN_STATUS = {"Current": 80, "Delinquent": 10, "Default": 2, "Paid Off": 8}
MERCHANTS = [
    "Amazon", "Walmart", "Target", "Starbucks", "Shell", "Uber", "Netflix", "Restaurant", "Grocery", "Travel",
]


def dim_customer(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_customer", "customers", "customer_key")
    return df.select(
        "customer_key",
        padded_id("CIF", F.col("customer_key"), 8).alias("customer_id"),
        first_name(u).alias("first_name"),
        last_name(u).alias("last_name"),
        u.date_between(
            "date_of_birth", cfg.years_before(81) + timedelta(days=1), cfg.years_before(18)
        ).alias("date_of_birth"),
        u.randint("ssn_last4", 1000, 9999).cast("string").alias("ssn_last4"),
        city(u).alias("city"),
        state(u).alias("state"),
        int_col(u.randint("credit_score", 300, 850)).alias("credit_score"),
        u.date_between("customer_since", cfg.start_date - timedelta(days=3650), cfg.start_date).alias("customer_since"),
        u.weighted("segment", SEGMENTS).alias("segment"),
    )


def dim_account(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_account", "accounts", "account_key")
    return df.select(
        "account_key",
        padded_id("ACCT", F.col("account_key"), 10).alias("account_id"),
        u.randint("customer_key", 1, cfg.n("customers")).alias("customer_key"),
        u.choice("account_type", ACCOUNT_TYPES).alias("account_type"),
        u.date_between("open_date", cfg.start_date - timedelta(days=1825), cfg.end_date).alias("open_date"),
        u.weighted("status", ACCOUNT_STATUS).alias("status"),
        money(u.randint("current_balance", 10000, 10000000)).alias("current_balance"),
    )


def dim_branch(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_branch", "branches", "branch_key")
    return df.select(
        "branch_key",
        padded_id("BR", F.col("branch_key"), 4).alias("branch_id"),
        F.concat(city(u, "name_city"), F.lit(" Branch")).alias("branch_name"),
        city(u).alias("city"),
        state(u).alias("state"),
        u.choice("region", BRANCH_REGIONS).alias("region"),
    )


def fact_transactions(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "fact_transactions", "transactions", "transaction_id")
    amount = F.col("_amount")
    return df.select(
        "transaction_id",
        date_key(u, cfg).alias("date_key"),
        u.skewed_key("account_key", cfg.n("accounts")).alias("account_key"),
        u.randint("branch_key", 1, cfg.n("branches")).alias("branch_key"),
        u.weighted("transaction_type", TXN_TYPES).alias("transaction_type"),
        u.randint("amount", 1000, 500000).alias("_amount"),
        u.choice("channel", TXN_CHANNELS).alias("channel"),
        F.concat(F.lit("REF-"), u.randint("reference", 100000000, 999999999).cast("string")).alias("reference"),
    ).select(
        "transaction_id", "date_key", "account_key", "branch_key", "transaction_type",
        money(F.when(F.col("transaction_type").isin(OUTFLOWS), -amount).otherwise(amount)).alias("amount"),
        "channel", "reference",
    )


def _by_loan_type(kind, pieces):
    """CASE over the loan type with the last entry as default."""
    out = None
    for name, value in pieces.items():
        if name is not None:
            out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out.otherwise(pieces[None])


def monthly_payment(principal, rate_hundredths, term):
    """Annuity instalment of a loan in dollars, as a double."""
    r = rate_hundredths / F.lit(120000.0)
    return principal * r / (F.lit(1.0) - F.power(F.lit(1.0) + r, -term))


def fact_loans(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "fact_loans", "customers", "loan_id", cfg.n("customers") // 3)
    kind = F.col("loan_type")
    df = df.select(
        "loan_id",
        date_key(u, cfg).alias("date_key"),
        u.randint("customer_key", 1, cfg.n("customers")).alias("customer_key"),
        u.randint("branch_key", 1, cfg.n("branches")).alias("branch_key"),
        u.choice("loan_type", LOAN_TYPES).alias("loan_type"),
        u.bits("principal").alias("_p"), u.bits("interest_rate").alias("_r"), u.bits("term_months").alias("_t"),
        u.weighted("status", LOAN_STATUS).alias("status"),
    )

    def ranged(draw, low, high, unit):
        return F.lit(low * unit) + draw % F.lit((high - low) * unit + 1)

    df = df.withColumns({
        "_cents": _by_loan_type(kind, {k: ranged(F.col("_p"), *v[0], 100) for k, v in LOAN_TERMS.items()}),
        "_rate": _by_loan_type(kind, {k: ranged(F.col("_r"), *v[1], 1) for k, v in LOAN_TERMS.items()}),
        "term_months": _by_loan_type(kind, {
            k: F.element_at(F.array(*[F.lit(m) for m in v[2]]), (F.col("_t") % F.lit(len(v[2])) + F.lit(1)).cast("int"))
            for k, v in LOAN_TERMS.items()
        }),
    })
    return df.select(
        "loan_id", "date_key", "customer_key", "branch_key", "loan_type",
        money(F.col("_cents")).alias("principal"),
        (F.col("_rate") / F.lit(100.0)).cast("decimal(5,2)").alias("interest_rate"),
        "term_months",
        monthly_payment(
            F.col("_cents") / F.lit(100.0), F.col("_rate"), F.col("term_months").cast("double")
        ).cast("decimal(18,2)").alias("monthly_payment"),
        "status",
    )


def fact_cards(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "fact_cards", "transactions", "card_txn_id", cfg.n("transactions") // 2)
    return df.select(
        "card_txn_id",
        date_key(u, cfg).alias("date_key"),
        u.skewed_key("customer_key", cfg.n("customers")).alias("customer_key"),
        u.choice("merchant_category", MERCHANTS).alias("merchant_category"),
        money(u.randint("amount", 500, 50000)).alias("amount"),
        u.choice("card_type", ["Debit", "Credit"]).alias("card_type"),
        u.chance("is_international", 0.05).alias("is_international"),
    )


TABLES = {
    "dim_date": dim_date,
    "dim_customer": dim_customer,
    "dim_account": dim_account,
    "dim_branch": dim_branch,
    "fact_transactions": fact_transactions,
    "fact_loans": fact_loans,
    "fact_cards": fact_cards,
}
