"""Binding of the claims and chronic-disease model to the star-schema parquet files.

Customers play the persons, orders the claims, order lines the facts.  Each
function returns a lazy DataFrame with only the columns its role needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.bands import band_left_closed
from strataspark.functions.hashing import mask_at_rate
from strataspark.functions.scalar import month_index, pattern_label, service_month
from strataspark.sources.codes import AGE_EDGES, AGE_LABELS

# Fixed values of the binding.
DIAGNOSIS_BRANDS = ["Brand#1", "Brand#2", "Brand#3"]
EXPOSURE_TYPES = ["ECONOMY"]
TYPE_GROUPS = {
    "MTX": ["ECONOMY"],
    "SSZ": ["LARGE"],
    "TNFI": ["MEDIUM"],
    "IL6I": ["PROMO"],
    "ABT": ["SMALL"],
    "CS": ["STANDARD"],
    "LEF": ["ABSENT"],
}
RETURN_FLAGS = {"TJR": ["A"], "BMD": ["N"], "VISIT": ["R"]}
CHRONIC_AGE_EDGES = [0, 40, 50, 60, 70, 80, 200]
CHRONIC_AGE_LABELS = ["under 40", "40-49", "50-59", "60-69", "70-79", "80+"]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def patients(spark: SparkSession, folder: str) -> DataFrame:
    """One row per person."""
    key = F.col("c_custkey")
    age = (F.lit(16) + key % 80).cast("int")
    return read(spark, folder, "customer").select(
        key.alias("common_key"),
        age.alias("age"),
        band_left_closed(age, AGE_EDGES, AGE_LABELS).alias("age_group"),
        F.when(key % 2 == 0, F.lit("1")).otherwise(F.lit("2")).alias("sex"),
        F.col("c_nationkey").alias("nation"),
    )


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per claim: claim key, person, month."""
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("receipt_id"),
        F.col("o_custkey").alias("common_key"),
        service_month(F.col("o_orderdate")).alias("service_month"),
    )


def _coded_lines(spark: SparkSession, folder: str, part_column: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    parts = read(spark, folder, "part").select("p_partkey", F.col(part_column).alias("code"))
    # No broadcast hint: parts grow with the data, so the planner decides by size.
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("receipt_id"), "code"
    )


def disease_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Diagnosis facts by claim: claim key and code."""
    return _coded_lines(spark, folder, "p_brand")


def medication_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Medication facts by claim: claim key and code."""
    return _coded_lines(spark, folder, "p_type")


def procedure_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Procedure facts by claim: claim key and code."""
    return read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("receipt_id"), F.col("l_returnflag").alias("code")
    )


def follow_up(spark: SparkSession, folder: str) -> DataFrame:
    """Per person: first claim date, months to the event or to the last claim, and the event.

    The event is the first urgent claim over 300,000.  One aggregation over the
    orders finds all three months.
    """
    month = month_index(F.col("o_orderdate"))
    hit = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)
    spans = (
        read(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("common_key"))
        .agg(
            F.min("o_orderdate").cast("date").alias("first_date"),
            F.min(month).alias("first_month"),
            F.max(month).alias("last_month"),
            F.min(F.when(hit, month)).alias("event_month"),
        )
    )
    return spans.select(
        "common_key",
        "first_date",
        (F.coalesce("event_month", "last_month") - F.col("first_month")).alias("months"),
        F.col("event_month").isNotNull().cast("int").alias("event"),
    )


def survival_input(spark: SparkSession, folder: str) -> DataFrame:
    """Person, months, event, and the two groups of the survival questions."""
    key = F.col("common_key")
    return follow_up(spark, folder).select(
        "common_key",
        "months",
        "event",
        (key % 2).cast("int").alias("grp"),
        F.when(F.lit(16) + key % 80 < 70, F.lit("under 70")).otherwise(F.lit("70 and over")).alias("stratum"),
    )


def chronic_cohort(spark: SparkSession, folder: str) -> DataFrame:
    """Persons of the chronic-disease study with nullable measures, one row each."""
    persons = read(spark, folder, "customer")
    key = F.col("c_custkey")
    age = (F.lit(16) + key % 80).cast("int")
    ht = F.col("c_acctbal") > 4500
    dl = key % 3 == 0
    ckd = F.col("c_mktsegment") == "MACHINERY"
    prefecture = F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0")
    hba1c = F.round((F.col("c_acctbal") + 1000) / 3000 + 6, 1)
    bmi = F.lit(16.0) + (key * 7 % 200) / 10
    base = persons.select(
        key.alias("patient_id"),
        F.when(key % 2 == 0, F.lit("M")).otherwise(F.lit("F")).alias("sex"),
        (F.lit(2020) - age).alias("birth_year"),
        age.alias("age"),
        band_left_closed(age, CHRONIC_AGE_EDGES, CHRONIC_AGE_LABELS).alias("age_group"),
        mask_at_rate(prefecture, key, "prefecture", 0.02).alias("prefecture_code"),
        ht.alias("has_hypertension"),
        dl.alias("has_dyslipidemia"),
        ckd.alias("has_ckd"),
        pattern_label({"HT": ht, "DL": dl, "CKD": ckd}, "+", " only", "none").alias("comorbidity_pattern"),
        mask_at_rate(hba1c, key, "hba1c", 0.08).alias("hba1c"),
        mask_at_rate(bmi, key, "bmi", 0.05).alias("bmi"),
    )
    times = follow_up(spark, folder).select(
        F.col("common_key").alias("patient_id"),
        F.col("first_date").alias("diabetes_diagnosis_date"),
        F.col("months").alias("follow_up_months"),
        (F.col("event") == 1).alias("cv_event_occurred"),
    )
    return base.join(times, "patient_id")


def checkups(spark: SparkSession, folder: str) -> DataFrame:
    """Check-up visits with nullable dates and measures, one row per order."""
    key = F.col("o_orderkey")
    visit = F.col("o_orderdate").cast("date")
    birth = F.date_sub(F.to_date(F.lit("1995-01-01")), ((F.lit(16) + F.col("o_custkey") % 80) * 365).cast("int"))
    return read(spark, folder, "orders").select(
        key.alias("visit_id"),
        mask_at_rate(visit, key, "visit", 0.02).alias("visit_date"),
        mask_at_rate(birth, key, "birth", 0.02).alias("birth_date"),
        mask_at_rate(F.round(F.col("o_totalprice") / 10000 + 40, 1), key, "weight", 0.03).alias("weight"),
        (F.lit(140.0) + key % 50).alias("height"),
    )
