"""Code groups and published reference values as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: clinical code lists, age bands and published results ------

AGE_EDGES = [16, 20, 30, 40, 50, 60, 70, 80, 85, 150]
AGE_LABELS = ["16-19", "20-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80-84", "85+"]
AGE_RANGES = [
    ("16-19", 16, 19), ("20-29", 20, 29), ("30-39", 30, 39), ("40-49", 40, 49), ("50-59", 50, 59),
    ("60-69", 60, 69), ("70-79", 70, 79), ("80-84", 80, 84),
]
BMI_EDGES = [0, 18.5, 25, 30, 100]
BMI_LABELS = ["Underweight", "Normal", "Overweight", "Obese"]

DIAGNOSIS_CODES = [
    "M050", "M051", "M052", "M053", "M058", "M059",
    "M060", "M062", "M063", "M068", "M069",
    "M080", "M083", "M084", "M088", "M089",
]
EXCLUDED_DIAGNOSIS_CODES = ["M061", "M064", "M081", "M082"]

DRUG_GROUPS = {
    "MTX": ["1199101", "1199102"],
    "SSZ": ["1199201"],
    "BUC": ["1199401"],
    "TAC": ["1199301"],
    "IGT": ["1199501"],
    "LEF": ["1199601"],
    "TNFI": ["4400101", "4400102", "4400103", "4400104", "4400105"],
    "IL6I": ["4400201", "4400202"],
    "ABT": ["4400301"],
    "JAKi": ["4400401", "4400402"],
}
STEROID_CODES = ["2454001", "2454002", "2454003"]
PROCEDURE_TYPES = ["TJR", "ARTHROPLASTY", "SYNOVECTOMY", "ULTRASOUND", "BMD"]
BIOLOGIC_GROUPS = ["TNFI", "IL6I", "ABT"]
SURGERY_TYPES = ["TJR", "ARTHROPLASTY", "SYNOVECTOMY"]

# definition name -> least number of exposure months (0 = diagnosis code alone)
DEFINITIONS = {"def_0": 0, "def_2": 1, "def_3": 2, "def_4": 6}

PUBLISHED_AGE_TABLE = {
    "16-19": (0.5, 0.03),
    "20-29": (1.5, 0.07),
    "30-39": (4.8, 0.27),
    "40-49": (10.1, 0.44),
    "50-59": (14.9, 0.79),
    "60-69": (26.4, 1.23),
    "70-79": (28.6, 1.63),
    "80-84": (6.1, 1.14),
    "85+": (7.0, 0.89),
    "Total": (100.0, 0.65),
}
PUBLISHED_FEMALE_PCT = {
    "16-19": 64.0, "20-29": 79.8, "30-39": 80.7, "40-49": 80.7, "50-59": 79.3,
    "60-69": 76.9, "70-79": 74.3, "80-84": 74.2, "85+": 77.7,
}
PUBLISHED_SEX_RATIO = {
    "16-19": 1.77, "20-29": 3.94, "30-39": 3.61, "40-49": 4.18, "50-59": 3.84,
    "60-69": 3.33, "70-79": 2.89, "80-84": 2.88, "85+": 3.49,
}
PUBLISHED_REPLACEMENT_PCT = 0.93
PUBLISHED_MTX = {
    "16-19": 59.9, "20-29": 60.9, "30-39": 64.7, "40-49": 69.9, "50-59": 73.1,
    "60-69": 70.9, "70-79": 60.4, "80-84": 50.5, "85+": 38.2,
}
PUBLISHED_BIOLOGICS = {
    "16-19": 50.9, "20-29": 42.9, "30-39": 34.8, "40-49": 30.9, "50-59": 27.9,
    "60-69": 22.4, "70-79": 17.8, "80-84": 15.0, "85+": 13.7,
}
PUBLISHED_SUMMARY = {
    "Total RA Patients (Definition 3)": "825,772",
    "Prevalence (%)": "0.65",
    "Female Ratio (%)": "76.3",
    "Age >= 65 years (%)": "60.8",
    "Age >= 85 years (%)": "7.0",
    "MTX Usage (%)": "63.4",
    "bDMARDs Usage (%)": "22.9",
    "Corticosteroid Usage (%)": "~45.0",
    "RA Surgery Rate (%)": "1.35",
}

PREFECTURE_NAMES = {
    "01": "Hokkaido", "11": "Saitama", "12": "Chiba", "13": "Tokyo", "14": "Kanagawa",
    "22": "Shizuoka", "23": "Aichi", "27": "Osaka", "28": "Hyogo", "40": "Fukuoka",
}

JAPANESE_COLUMNS = {
    "common_key": "共通キー",
    "receipt_id": "検索番号",
    "data_type": "データ識別",
    "service_month": "診療年月",
    "gender": "男女区分",
    "birth_date": "生年月日",
    "drug_code": "医薬品コード",
    "icd10_code": "ICD10コード",
}

# Source columns of the health check-up table and the names used here.
CHECKUP_COLUMNS = {
    "健診年月日to": "visit_date",
    "生年月日to": "birth_date",
    "体重9n006": "weight",
    "身長9n001": "height",
}

# --- end of fixed values -------------------------------------------------------

_ARROW_TYPES = {
    "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(),
}


def flatten(groups: Mapping[str, Sequence[str]]) -> list[str]:
    """All codes of all groups, each once, in order."""
    return list(dict.fromkeys(code for codes in groups.values() for code in codes))


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A driver-side table of constants with a schema such as ``"code string, n long"``.

    It becomes a local relation of known size, so the planner broadcasts it
    when it is small and does not when a long code list makes it large.
    """
    fields = [column.split() for column in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    table = pa.table(
        {name: pa.array(values, _ARROW_TYPES[kind]) for (name, kind), values in zip(fields, columns)}
    )
    return spark.createDataFrame(table)


def published_by_age() -> dict[str, tuple[float | None, ...]]:
    """Published share, prevalence, female share and sex ratio by age band."""
    return {
        band: (*values, PUBLISHED_FEMALE_PCT.get(band), PUBLISHED_SEX_RATIO.get(band))
        for band, values in PUBLISHED_AGE_TABLE.items()
    }


def code_set(spark: SparkSession, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Code lists as rows ``(code_group, code)``."""
    rows = [(group, code) for group, codes in groups.items() for code in codes]
    return literal_table(spark, rows, "code_group string, code string")


def reference_values(
    spark: SparkSession, values: Mapping[str, object], label: str, columns: Sequence[str]
) -> DataFrame:
    """Published numbers as rows keyed by ``label``, typed explicitly as doubles."""
    rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in values.items()]
    schema = ", ".join([f"{label} string", *[f"{c} double" for c in columns]])
    return literal_table(spark, rows, schema)
