"""Datasets of the patient dashboard and the check-up dashboard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.bands import decode
from strataspark.functions.scalar import age_at, in_range
from strataspark.operators import dashboard as da
from strataspark.sources.codes import CHECKUP_COLUMNS, PREFECTURE_NAMES
from strataspark.sources.tables import localize_columns, scan_derived

SINGLE_FILTERS = ["sex"]
MULTI_FILTERS = ["age_group", "prefecture_name", "comorbidity_pattern"]
FACETS = [*SINGLE_FILTERS, *MULTI_FILTERS]


def patient_base(df: DataFrame) -> DataFrame:
    """Patients with a known prefecture, its name and the year of diagnosis."""
    return df.filter(F.col("prefecture_code").isNotNull()).select(
        "patient_id",
        "sex",
        "age",
        "age_group",
        "prefecture_code",
        decode(F.col("prefecture_code"), PREFECTURE_NAMES, "Other").alias("prefecture_name"),
        F.year("diabetes_diagnosis_date").alias("diagnosis_year"),
        "diabetes_diagnosis_date",
        "has_hypertension",
        "has_dyslipidemia",
        "has_ckd",
        "comorbidity_pattern",
        "cv_event_occurred",
        "follow_up_months",
        "hba1c",
        "bmi",
    )


def filtered(df: DataFrame, sex: str | None = None, **multi: Sequence[str]) -> DataFrame:
    """The base dataset under one sex and any number of listed values per other field."""
    unknown = set(multi) - set(MULTI_FILTERS)
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    chosen: dict[str, Sequence[str]] = {"sex": [sex] if sex else [], **multi}
    return da.apply_filters(df, chosen)


def facets(df: DataFrame, selections: Mapping[str, Sequence[str]]) -> DataFrame:
    return da.facet_counts(df, FACETS, selections)


def checkup_base(df: DataFrame) -> DataFrame:
    """All columns of visits with both dates, plus the age at the visit.

    Source column names are translated first; names already translated stay.
    """
    df = localize_columns(df, CHECKUP_COLUMNS)
    both = F.col("visit_date").isNotNull() & F.col("birth_date").isNotNull()
    return scan_derived(df, {"age": age_at(F.col("visit_date"), F.col("birth_date"))}, both)


def age_histogram(visits: DataFrame) -> DataFrame:
    """Visits by year of age, among those with a weight of at least 0."""
    return da.histogram(visits, "age", 1, in_range(F.col("weight"), 0.0, None))
