"""Declared table schemas with column comments, one place for writers and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataspark.sources.codes import DRUG_GROUPS, PROCEDURE_TYPES, literal_table

_FLAGS = [*DRUG_GROUPS, "CS", "bDMARDs", "any_DMARD", *PROCEDURE_TYPES, "any_RA_surgery"]
_MEDICATION_RATES = [*DRUG_GROUPS, "CS", "bDMARDs"]
_PROCEDURE_RATES = [*PROCEDURE_TYPES, "any_RA_surgery"]


def _table(*columns: tuple[str, str, str]) -> StructType:
    """A schema from ``(name, type, comment)``; needs no running session."""
    schema = StructType()
    for name, data_type, comment in columns:
        schema.add(name, data_type, True, {"comment": comment})
    return schema


BRONZE = {
    "patients": _table(
        ("patient_id", "long", "running number"),
        ("common_key", "string", "pseudonymous person key"),
        ("age", "integer", "years at the reference date"),
        ("age_group", "string", "age band"),
        ("sex", "string", "1 male, 2 female"),
        ("birth_date", "string", "yyyy-MM-dd"),
        ("is_ra_candidate", "boolean", "candidate mark"),
    ),
    "re_receipt": _table(
        ("common_key", "string", "person key"),
        ("receipt_id", "string", "claim key"),
        ("data_type", "string", "1 medical, 2 bundled"),
        ("service_month", "string", "yyyyMM"),
        ("gender", "string", "1 male, 2 female"),
        ("birth_date", "string", "yyyy-MM-dd"),
        ("fy", "string", "fiscal year"),
        ("year", "string", "yyyy"),
        ("month", "string", "MM"),
        ("prefecture_number", "string", "01 to 47"),
    ),
    "sy_disease": _table(
        ("common_key", "string", "person key"),
        ("receipt_id", "string", "claim key"),
        ("icd10_code", "string", "diagnosis code"),
        ("service_month", "string", "yyyyMM"),
    ),
    "iy_medication": _table(
        ("common_key", "string", "person key"),
        ("receipt_id", "string", "claim key"),
        ("drug_code", "string", "drug code"),
        ("drug_category", "string", "drug class"),
        ("drug_name", "string", "drug name"),
    ),
    "si_procedure": _table(
        ("common_key", "string", "person key"),
        ("receipt_id", "string", "claim key"),
        ("procedure_type", "string", "procedure type"),
    ),
    "ho_insurer": _table(
        ("common_key", "string", "person key"),
        ("insurer_type", "string", "insurance scheme"),
        ("insurer_number", "string", "insurer number"),
    ),
}

SILVER = {
    "cohort": _table(
        ("patient_id", "long", "running number"),
        ("common_key", "string", "person key"),
        ("age", "integer", "years"),
        ("age_group", "string", "age band"),
        ("sex", "string", "1 male, 2 female"),
        ("birth_date", "string", "yyyy-MM-dd"),
        ("is_ra_candidate", "boolean", "candidate mark"),
        ("prescription_months", "long", "distinct months with exposure"),
        *[(flag, "integer", "0 or 1") for flag in _FLAGS],
    ),
    "definitions_summary": _table(
        ("definition", "string", "cohort definition"),
        ("n_patients", "long", "members"),
        ("prevalence_pct", "double", "percent of the population"),
    ),
}

GOLD = {
    "age_distribution": _table(
        ("age_group", "string", "age band or Total"),
        ("n", "long", "members"),
        ("pct_of_total", "double", "percent of the cohort"),
        ("female_pct", "double", "percent female"),
        ("fm_ratio", "double", "female to male ratio"),
        ("prevalence", "double", "percent of the population of the band"),
        ("paper_pct", "double", "published percent of the cohort"),
        ("paper_prevalence", "double", "published prevalence"),
        ("sort_key", "integer", "display position"),
    ),
    "medication_usage": _table(
        ("age_group", "string", "age band or Total"),
        ("n", "long", "members"),
        *[(flag, "double", "percent of members") for flag in _MEDICATION_RATES],
        ("TNFI_ABT_ratio", "double", "ratio of two rates"),
        ("sort_key", "integer", "display position"),
    ),
    "procedure_usage": _table(
        ("age_group", "string", "age band or Total"),
        ("n", "long", "members"),
        *[(flag, "double", "percent of members") for flag in _PROCEDURE_RATES],
        ("sort_key", "integer", "display position"),
    ),
    "summary": _table(
        ("metric", "string", "metric name"),
        ("reproduced", "string", "value found"),
        ("paper", "string", "published value"),
        ("note", "string", "remark"),
    ),
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns in declared order and type, with their comments; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing for the declared schema: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema])


def schema_table(spark: SparkSession, schema: StructType) -> DataFrame:
    """A declared schema as rows ``(position, column, type, nullable, comment)``."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment"))
        for i, f in enumerate(schema, start=1)
    ]
    return literal_table(
        spark, rows, "position int, column_name string, data_type string, nullable boolean, comment string"
    )
