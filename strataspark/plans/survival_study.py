"""The chronic-disease study: selection, imputation, description, survival.

Everything stays a DataFrame; what a caller collects at the end is a curve of
distinct months or a single test row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.bands import band_right_closed
from strataspark.operators import cohort as co
from strataspark.operators import profile as pr
from strataspark.operators import rates as ra
from strataspark.operators import survival as su
from strataspark.operators.quantiles import impute_median
from strataspark.sources.codes import BMI_EDGES, BMI_LABELS
from strataspark.sources.tables import scan_table, write_overwrite


def criteria(min_age: int, last_diagnosis: str) -> list[tuple[str, Column]]:
    """Inclusion steps in order."""
    return [
        (f"age {min_age}+", F.col("age") >= min_age),
        (f"diagnosed by {last_diagnosis}", F.col("diabetes_diagnosis_date") <= F.to_date(F.lit(last_diagnosis))),
        ("prefecture known", F.col("prefecture_code").isNotNull()),
    ]


def attrition(df: DataFrame, min_age: int = 40, last_diagnosis: str = "2018-12-31") -> DataFrame:
    return co.attrition_cascade(df, criteria(min_age, last_diagnosis))


def select_cohort(df: DataFrame, min_age: int = 40, last_diagnosis: str = "2018-12-31") -> DataFrame:
    """Persons who meet every criterion."""
    kept = df
    for _, test in criteria(min_age, last_diagnosis):
        kept = kept.filter(test)
    return kept


def analysis_cohort(
    df: DataFrame,
    min_age: int = 40,
    last_diagnosis: str = "2018-12-31",
    measures: Sequence[str] = ("hba1c", "bmi"),
    path: str | None = None,
) -> DataFrame:
    """The selected persons with imputed ``measures`` (the BMI among them) and derived columns.

    Medians are taken over the selected persons, so the selection is read a few
    times; with ``path`` it is derived once, stored there and read from there.
    """
    kept = select_cohort(df, min_age, last_diagnosis)
    if path is not None:
        write_overwrite(kept, path)
        kept = scan_table(kept.sparkSession, path)
    kept = impute_median(kept, list(measures))
    return derive_events(kept).withColumn(
        "bmi_category", band_right_closed(F.col("bmi_imputed"), BMI_EDGES, BMI_LABELS)
    )


def derive_events(df: DataFrame) -> DataFrame:
    """0/1 copies of the booleans."""
    return df.withColumns(
        {
            "event": F.col("cv_event_occurred").cast("int"),
            "has_hypertension_int": F.col("has_hypertension").cast("int"),
            "has_dyslipidemia_int": F.col("has_dyslipidemia").cast("int"),
            "has_ckd_int": F.col("has_ckd").cast("int"),
        }
    )


def summary(cohort: DataFrame, male: str = "M") -> DataFrame:
    return pr.cohort_summary(
        cohort,
        "follow_up_months",
        F.col("cv_event_occurred"),
        {
            "hypertension": F.col("has_hypertension"),
            "dyslipidemia": F.col("has_dyslipidemia"),
            "ckd": F.col("has_ckd"),
        },
        "age",
        F.col("sex") == male,
    )


def events_by_pattern(cohort: DataFrame) -> DataFrame:
    return ra.grouped_events(cohort, "comorbidity_pattern", "event")


def curves_by_hypertension(cohort: DataFrame) -> DataFrame:
    return su.km_confidence(su.kaplan_meier(cohort, "follow_up_months", "event", ["has_hypertension"]))


def curves_by_pattern(cohort: DataFrame, k: int = 5) -> DataFrame:
    return su.km_by_pattern(cohort, "follow_up_months", "event", "comorbidity_pattern", k)


def test_by_hypertension(cohort: DataFrame) -> DataFrame:
    return su.logrank_pvalue(
        su.logrank_test(cohort, "follow_up_months", "event", "has_hypertension", False, True)
    )


def test_by_age_stratum(cohort: DataFrame, cut: int = 70) -> DataFrame:
    stratum = F.when(F.col("age") < cut, F.lit(f"under {cut}")).otherwise(F.lit(f"{cut} and over"))
    return su.subgroup_logrank(
        cohort.withColumn("stratum", stratum), "follow_up_months", "event", "has_hypertension", False, True, "stratum"
    )


def rate_ratio(cohort: DataFrame) -> DataFrame:
    return su.event_rate_ratio(cohort, F.col("has_hypertension"), "event")


def run(
    df: DataFrame,
    target: str,
    min_age: int = 40,
    last_diagnosis: str = "2018-12-31",
    measures: Sequence[str] = ("hba1c", "bmi"),
    k: int = 5,
    cut: int = 70,
) -> dict[str, int]:
    """Store the cohort and every result of the study below a folder; returns rows per table.

    The folder must be shared by the executors.  The cohort is derived once,
    with its measures imputed, and every result reads the stored one.  Each
    table replaces its former state, so a run that was cut off is repeated.
    """
    spark = df.sparkSession
    written: dict[str, int] = {}

    def store(name: str, table: DataFrame) -> DataFrame:
        written[name] = write_overwrite(table, f"{target}/{name}")
        return scan_table(spark, f"{target}/{name}")

    store("attrition", attrition(df, min_age, last_diagnosis))
    cohort = store("cohort", analysis_cohort(df, min_age, last_diagnosis, measures, f"{target}/selection"))
    store("summary", summary(cohort))
    store("events_by_pattern", events_by_pattern(cohort))
    store("curves_by_hypertension", curves_by_hypertension(cohort))
    store("curves_by_pattern", curves_by_pattern(cohort, k))
    store("test_by_hypertension", test_by_hypertension(cohort))
    store("tests_by_age", test_by_age_stratum(cohort, cut))
    store("rate_ratio", rate_ratio(cohort))
    return written
