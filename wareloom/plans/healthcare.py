"""Hospital encounters, procedures and billing."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.config import GenConfig
from wareloom.functions.draws import Draws, key_draw, money, padded_id, pick, share
from wareloom.operators.ranking import expand_with_running_id
from wareloom.plans.common import city, date_key, dim_date, first_name, int_col, last_name, positions, seeded, state

# Fixed values.
BLOOD_TYPES = ["A+", "A-", "B+", "B-", "O+", "O-", "AB+", "AB-"]
INSURANCE = ["Commercial", "Medicare", "Medicaid", "Self-Pay"]
SPECIALTIES = [
    "Family Medicine", "Internal Medicine", "Cardiology", "Orthopedics",
    "Pediatrics", "Neurology", "Oncology", "Emergency Medicine",
]
HOSPITAL_WORDS = ["Medical Center", "Hospital", "Health System"]
HOSPITAL_TYPES = ["General", "Teaching", "Specialty", "Community"]
DIAGNOSES = [
    ("J06.9", "Acute upper respiratory infection"),
    ("I10", "Essential hypertension"),
    ("E11.9", "Type 2 diabetes mellitus"),
    ("M54.5", "Low back pain"),
    ("J18.9", "Pneumonia"),
    ("K21.0", "GERD"),
    ("F32.9", "Major depressive disorder"),
    ("J45.909", "Asthma"),
    ("M79.3", "Panniculitis"),
    ("R10.9", "Abdominal pain"),
]
VISIT_TYPES = {"Outpatient": 60, "Inpatient": 20, "Emergency": 15, "Observation": 5}
PROCEDURES = [
    ("99213", "Office visit - established"),
    ("99214", "Office visit - detailed"),
    ("36415", "Blood draw"),
    ("71046", "Chest X-ray"),
    ("93000", "ECG"),
    ("80053", "Comprehensive metabolic panel"),
    ("85025", "Complete blood count"),
]
CLAIM_STATUS = {"Paid": 70, "Pending": 15, "Denied": 10, "Appealed": 5}
MAX_PROCEDURES = 4


def dim_patient(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_patient", "patients", "patient_key")
    return df.select(
        "patient_key",
        padded_id("MRN", F.col("patient_key"), 8).alias("patient_id"),
        first_name(u).alias("first_name"),
        last_name(u).alias("last_name"),
        u.date_between(
            "date_of_birth", cfg.years_before(91) + timedelta(days=1), cfg.years_before(1)
        ).alias("date_of_birth"),
        u.choice("gender", ["M", "F"]).alias("gender"),
        u.choice("blood_type", BLOOD_TYPES).alias("blood_type"),
        city(u).alias("city"),
        state(u).alias("state"),
        u.choice("insurance_type", INSURANCE).alias("insurance_type"),
    )


def dim_doctor(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_doctor", "doctors", "doctor_key")
    return df.select(
        "doctor_key",
        F.concat(F.lit("NPI-"), u.randint("doctor_id", 1000000000, 9999999999).cast("string")).alias("doctor_id"),
        first_name(u).alias("first_name"),
        last_name(u).alias("last_name"),
        u.choice("specialty", SPECIALTIES).alias("specialty"),
        int_col(u.randint("years_experience", 1, 35)).alias("years_experience"),
    )


def dim_hospital(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "dim_hospital", "hospitals", "hospital_key")
    return df.select(
        "hospital_key",
        padded_id("HOSP", F.col("hospital_key"), 4).alias("hospital_id"),
        F.concat_ws(" ", city(u, "name_city"), u.choice("name_word", HOSPITAL_WORDS)).alias("hospital_name"),
        city(u).alias("city"),
        state(u).alias("state"),
        int_col(u.randint("bed_count", 50, 500)).alias("bed_count"),
        u.choice("hospital_type", HOSPITAL_TYPES).alias("hospital_type"),
    )


def dim_diagnosis(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    rows = [(i + 1, code, text) for i, (code, text) in enumerate(DIAGNOSES)]
    df = spark.createDataFrame(rows, "diagnosis_key bigint, icd10_code string, diagnosis_description string")
    return df.withColumn("category", F.split_part("diagnosis_description", F.lit(" "), F.lit(1)))


def _visit(u: Draws) -> dict[str, Column]:
    return {"visit_type": u.weighted("visit_type", VISIT_TYPES), "_charge": u.bits("total_charges")}


def _charges() -> Column:
    """Cents: 100-1000 dollars for outpatients, 200-50000 otherwise."""
    return F.when(
        F.col("visit_type") == "Outpatient", F.lit(10000) + F.col("_charge") % F.lit(90001)
    ).otherwise(F.lit(20000) + F.col("_charge") % F.lit(4980001))


def fact_encounters(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    df, u = seeded(spark, cfg, "fact_encounters", "encounters", "encounter_id")
    return df.select(
        "encounter_id",
        date_key(u, cfg).alias("date_key"),
        u.skewed_key("patient_key", cfg.n("patients")).alias("patient_key"),
        u.randint("doctor_key", 1, cfg.n("doctors")).alias("doctor_key"),
        u.randint("hospital_key", 1, cfg.n("hospitals")).alias("hospital_key"),
        u.randint("diagnosis_key", 1, len(DIAGNOSES)).alias("diagnosis_key"),
        u.randint("length_of_stay", 1, 10).alias("_stay"),
        *[c.alias(n) for n, c in _visit(u).items()],
    ).select(
        "encounter_id", "date_key", "patient_key", "doctor_key", "hospital_key", "diagnosis_key", "visit_type",
        int_col(F.when(F.col("visit_type") == "Outpatient", F.lit(0)).otherwise(F.col("_stay"))).alias("length_of_stay"),
        money(_charges()).alias("total_charges"),
    )


def _n_procedures(cfg: GenConfig, encounter_id: str) -> Column:
    h = key_draw(cfg.seed, "healthcare.fact_encounters.n_procedures", encounter_id)
    return F.lit(1) + h % F.lit(MAX_PROCEDURES)


def fact_procedures(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    rows = expand_with_running_id(
        spark, cfg.n("encounters"), lambda p: _n_procedures(cfg, f"{p} + 1"), source=positions(spark, cfg, "encounters", name="position") if cfg.keys else None)
    df = rows.select(
        F.col("running_id").alias("procedure_id"),
        (F.col("position") + F.lit(1)).alias("encounter_id"),
        F.col("ordinal").alias("_line"),
    )
    e = Draws(cfg.seed, "healthcare.fact_encounters", "_e")
    u = Draws(cfg.seed, "healthcare.fact_procedures")
    df = u.attach(e.attach(df, "encounter_id"), "encounter_id * 8 + _line")
    return df.select(
        "procedure_id",
        "encounter_id",
        e.randint("doctor_key", 1, cfg.n("doctors")).alias("doctor_key"),
        u.index("procedure", len(PROCEDURES)).alias("_proc"),
        money(u.randint("charge_amount", 5000, 200000)).alias("charge_amount"),
    ).select(
        "procedure_id", "encounter_id", "doctor_key",
        pick([c for c, _ in PROCEDURES], F.col("_proc")).alias("cpt_code"),
        pick([d for _, d in PROCEDURES], F.col("_proc")).alias("procedure_description"),
        "charge_amount",
    )


def fact_billing(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    """One claim per encounter; the charges are recomputed from the encounter key."""
    df, u = seeded(spark, cfg, "fact_billing", "encounters", "encounter_id")
    e = Draws(cfg.seed, "healthcare.fact_encounters", "_e")
    df = e.attach(df, "encounter_id").withColumns(_visit(e)).withColumn("_total", _charges())
    df = df.withColumn("_allowed", share(F.col("_total"), u.randint("allowed_ratio", 3000, 8000)))
    df = df.withColumn("_paid", share(F.col("_allowed"), u.randint("paid_ratio", 7000, 10000)))
    return df.select(
        F.col("encounter_id").alias("billing_id"),
        "encounter_id",
        money(F.col("_total")).alias("total_charges"),
        money(F.col("_allowed")).alias("allowed_amount"),
        money(F.col("_paid")).alias("paid_amount"),
        money(F.col("_total") - F.col("_paid")).alias("patient_responsibility"),
        u.weighted("claim_status", CLAIM_STATUS).alias("claim_status"),
    )


TABLES = {
    "dim_date": dim_date,
    "dim_patient": dim_patient,
    "dim_doctor": dim_doctor,
    "dim_hospital": dim_hospital,
    "dim_diagnosis": dim_diagnosis,
    "fact_encounters": fact_encounters,
    "fact_procedures": fact_procedures,
    "fact_billing": fact_billing,
}
