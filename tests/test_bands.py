from pyspark.sql import functions as F

from strataspark.functions import bands
from strataspark.sources.codes import AGE_EDGES, AGE_LABELS, AGE_RANGES, BMI_EDGES, BMI_LABELS


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_left_closed_edges(spark):
    ages = [15, 16, 19, 20, 84, 85, 149, 150, None]
    found = column(spark, ages, bands.band_left_closed(F.col("v"), AGE_EDGES, AGE_LABELS), "int")
    assert found == [None, "16-19", "16-19", "20-29", "80-84", "85+", "85+", None, None]


def test_right_closed_edges(spark):
    values = [0.0, 0.1, 18.5, 18.6, 25.0, 30.0, 100.0, 101.0, None]
    found = column(spark, values, bands.band_right_closed(F.col("v"), BMI_EDGES, BMI_LABELS))
    assert found == [None, "Underweight", "Underweight", "Normal", "Normal", "Overweight", "Obese", None, None]


def test_between_keeps_null_apart(spark):
    expr = bands.band_between(F.col("v"), AGE_RANGES, "85+")
    assert column(spark, [16, 19, 20, 84, 85, 15, None], expr, "int") == [
        "16-19", "16-19", "20-29", "80-84", "85+", "85+", None,
    ]
    named = bands.band_between(F.col("v"), AGE_RANGES, "85+", "Unknown")
    assert column(spark, [None], named, "int") == ["Unknown"]


def test_decode_unknown_and_null(spark):
    expr = bands.decode(F.col("v"), {"01": "Hokkaido", "13": "Tokyo"}, "Other")
    assert column(spark, ["01", "13", "99", None], expr, "string") == ["Hokkaido", "Tokyo", "Other", "Other"]


def test_ordinal_total_last(spark):
    expr = bands.ordinal(F.col("v"), ["a", "b"])
    assert column(spark, ["b", "Total", "a", "x", None], expr, "string") == [2, 3, 1, 4, 4]


def test_bin_floor_negative_and_null(spark):
    expr = bands.bin_floor(F.col("v"), 0.5)
    assert column(spark, [0.0, 0.49, 0.5, -0.1, None], expr) == [0.0, 0.0, 0.5, -0.5, None]
