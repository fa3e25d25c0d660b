import math

import pytest
from pyspark.sql import functions as F

from strataspark.functions import hashing, scalar, stats


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_in_range_open_bounds(spark):
    x = F.lit(5.0)
    assert one(spark, scalar.in_range(x, 5.0, None)) is True
    assert one(spark, scalar.in_range(x, None, 5.0)) is True
    assert one(spark, scalar.in_range(x, 5.1, None)) is False
    assert one(spark, scalar.in_range(x, None, None)) is True
    assert one(spark, scalar.in_range(F.lit(None).cast("double"), 0.0, 1.0)) is None


def test_safe_ratio_zero_and_null(spark):
    assert one(spark, scalar.safe_ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, scalar.safe_ratio(F.lit(1), F.lit(None).cast("int"))) is None
    assert one(spark, scalar.safe_ratio(F.lit(1), F.lit(3), 100.0, 2)) == 33.33


def test_round_modes(spark):
    assert [one(spark, F.round(F.lit(v), d)) for v, d in [(0.5, 0), (1.5, 0), (2.5, 0), (2.675, 2)]] == [1, 2, 3, 2.68]
    assert [one(spark, F.bround(F.lit(v), d)) for v, d in [(0.5, 0), (1.5, 0), (2.5, 0)]] == [0, 2, 2]


@pytest.mark.parametrize(
    "ht,dl,ckd,label",
    [
        (True, True, True, "HT+DL+CKD"), (True, False, True, "HT+CKD"), (False, True, True, "DL+CKD"),
        (True, True, False, "HT+DL"), (False, False, True, "CKD only"), (True, False, False, "HT only"),
        (False, True, False, "DL only"), (False, False, False, "none"), (None, None, True, "CKD only"),
    ],
)
def test_pattern_label(spark, ht, dl, ckd, label):
    parts = {n: F.lit(v).cast("boolean") for n, v in (("HT", ht), ("DL", dl), ("CKD", ckd))}
    assert one(spark, scalar.pattern_label(parts, "+", " only", "none")) == label


def test_case_by_operand_truncates(spark):
    assert one(spark, scalar.case_by_operand(F.lit(2015), {2015: F.lit(36.9)}, F.lit(1.0))) == 36
    assert one(spark, scalar.case_by_operand(F.lit(1999), {2015: F.lit(36.9)}, F.lit(1.7))) == 1


def test_any_of_ignores_nulls(spark):
    df = spark.createDataFrame([(0, None), (None, 1), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(scalar.any_of(["a", "b"])).collect()] == [0, 1, 0]


def test_service_month_pads(spark):
    assert one(spark, scalar.service_month(F.to_date(F.lit("2017-04-09")))) == "201704"
    assert one(spark, scalar.month_index(F.to_date(F.lit("2017-04-09")))) == 2017 * 12 + 4


def test_age_counts_whole_years(spark):
    d = lambda s: F.to_date(F.lit(s))
    assert one(spark, scalar.age_at(d("2020-06-01"), d("1980-06-02"))) == 39
    assert one(spark, scalar.age_at(d("2020-06-02"), d("1980-06-02"))) == 40
    assert one(spark, scalar.age_at(F.lit(None).cast("date"), d("1980-06-02"))) is None


def test_pseudonym_is_sha256_prefix(spark):
    import hashlib

    assert one(spark, scalar.pseudonym("patient_", F.lit(7))) == hashlib.sha256(b"patient_7").hexdigest()[:32]


def test_uniform_is_repeatable_and_even(spark):
    df = spark.range(20000).select("id", hashing.keyed_uniform(F.col("id"), "s").alias("u"))
    again = df.repartition(3).agg(F.avg("u").alias("m"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert abs(again["m"] - 0.5) < 0.01 and 0 <= again["lo"] and again["hi"] < 1
    other = spark.range(20000).select("id", hashing.keyed_uniform(F.col("id"), "t").alias("w"))
    assert abs(df.join(other, "id").agg(F.corr("u", "w")).first()[0]) < 0.03


def test_weighted_bucket_shares(spark):
    draw = hashing.keyed_uniform(F.col("id"), "w")
    got = dict(
        spark.range(20000).groupBy(hashing.weighted_bucket(draw, {"a": 1, "b": 2, "c": 1}).alias("k")).count().collect()
    )
    assert set(got) == {"a", "b", "c"} and abs(got["b"] / 20000 - 0.5) < 0.02


def test_erfc_against_math(spark):
    for z in (0.0, 0.1, 0.5, 1.0, 2.0, 4.0):
        assert math.isclose(one(spark, stats.erfc(F.lit(z))), math.erfc(z), rel_tol=2e-7, abs_tol=0)
    assert one(spark, stats.chi2_upper_tail_df1(F.lit(0.0))) == 1.0
