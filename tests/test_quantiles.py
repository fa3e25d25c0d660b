import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators.quantiles import exact_quantiles, impute_median, medians


def median(df):
    return medians(df, ["v"]).first()["median"]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


@pytest.mark.parametrize(
    "values",
    [
        [3.0],
        [1.0, 2.0],
        [5.0, 1.0, 3.0],
        [2.0] * 7,
        [0.0, 0.0, 0.0, 1e9],
        [-1.5, None, 2.5, None, 4.0, 8.0],
        np.random.default_rng(1).normal(size=501).tolist(),
        np.random.default_rng(2).exponential(size=500).tolist(),
    ],
)
def test_median_matches_numpy(spark, values):
    expected = np.median([v for v in values if v is not None])
    assert median(frame(spark, values)) == pytest.approx(expected, abs=1e-12)


def test_median_of_nothing_is_null(spark):
    assert median(frame(spark, [None, None])) is None
    assert median(frame(spark, [])) is None


@pytest.mark.parametrize("q", [0.0, 0.1, 0.25, 0.75, 0.999, 1.0])
def test_other_quantiles(spark, q):
    values = np.random.default_rng(3).uniform(size=777).tolist()
    assert exact_quantiles(frame(spark, values), ["v"], q).first()["value"] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_large_column_with_a_hot_value(spark):
    # A third of the rows share one value; the sketch's bracket is narrow here.
    df = spark.range(0, 300_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise((F.xxhash64("id") % 1_000_003) / F.lit(1_000_003.0)).alias("v")
    )
    values = [r[0] for r in df.collect()]
    assert median(df) == pytest.approx(float(np.median(values)), abs=1e-12)


def test_impute_fills_only_nulls(spark):
    rng = random.Random(5)
    values = [rng.random() if rng.random() > 0.2 else None for _ in range(200)]
    out = impute_median(frame(spark, values), ["v"]).collect()
    middle = float(np.median([v for v in values if v is not None]))
    for r in out:
        assert r["v_imputed"] == (r["v"] if r["v"] is not None else pytest.approx(middle, abs=1e-12))


def test_columns_do_not_disturb_each_other(spark):
    df = spark.createDataFrame([(1.0, 10, None), (2.0, None, None), (9.0, 30, None)], "a double, b int, c double")
    assert [tuple(r) for r in medians(df, ["a", "b", "c"]).collect()] == [("a", 2.0), ("b", 20.0), ("c", None)]
    filled = impute_median(df, ["b", "c"]).orderBy("a").collect()
    assert [(r["b_imputed"], r["c_imputed"]) for r in filled] == [(10.0, None), (20.0, None), (30.0, None)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 31, 100, 10_007])
def test_no_bracket_misses_a_rank(spark, n):
    rng = random.Random(n)
    values = [float(rng.randint(0, 50)) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(2)
    for q in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0):
        place = (n - 1) * q
        low, high = sorted(values)[math.floor(place)], sorted(values)[math.ceil(place)]
        assert exact_quantiles(df, ["v"], q).first()["value"] == pytest.approx(low + (high - low) * (place - math.floor(place))), q
