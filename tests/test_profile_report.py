import pytest
from pyspark.sql import functions as F

from strataspark.operators import dashboard as da
from strataspark.operators import profile as pr
from strataspark.operators import report as rp


def test_missing_profile(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 2.0, None), (3, None, "z"), (4, 1.0, "w")], "id int, a double, b string")
    got = [tuple(r) for r in pr.missing_profile(df).collect()]
    assert got == [("a", 2, 50.0, "review"), ("b", 1, 25.0, "review")]
    assert pr.missing_profile(df.select("id")).collect() == []


def test_missing_profile_verdict(spark):
    df = spark.range(20).select(F.when(F.col("id") > 0, F.col("id")).alias("v"))
    assert pr.missing_profile(df).first()["verdict"] == "impute"


def test_value_counts_drops_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), ("b",)], "v string")
    assert [tuple(r) for r in pr.value_counts(df, "v").collect()] == [("b", 2), ("a", 1)]


def test_quality_summary_counts_each_category_once(spark, rows):
    df = spark.createDataFrame([("x", "1", 5), ("x", "2", 7), (None, "1", None)], "c string, d string, v int")
    got = pr.quality_summary(df, ["v"], ["c", "d"])
    assert rows(got) == sorted(
        [
            ("rows", None, 3.0), ("min_v", None, 5.0), ("max_v", None, 7.0), ("c", "x", 2.0), ("c", None, 1.0),
            ("d", "1", 2.0), ("d", "2", 1.0),
        ],
        key=repr,
    )


def test_expectations(spark, rows):
    metrics = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", None), ("d", 1.0)], "metric string, value double")
    checks = pr.expect_range(metrics, {"a": (5, 5), "b": (6, None), "c": (None, 9)})
    assert rows(checks) == [("a", 5.0, 5.0, 5.0, True), ("b", 5.0, 6.0, None, False), ("c", None, None, 9.0, False)]
    assert pr.require(checks.filter("metric = 'a'")).count() == 1
    with pytest.raises(Exception, match="expectation failed"):
        pr.require(checks).collect()


def test_metric_report_formats(spark):
    df = spark.range(1234)
    got = rp.metric_report(df, [("n", F.count(F.lit(1)), ",", ""), ("m", F.avg("id"), "%.1f", "mean")], {"n": "1"})
    assert [tuple(r) for r in got.collect()] == [("n", "1,234", "1", ""), ("m", "616.5", None, "mean")]


def test_compare_to_reference(spark, rows):
    df = spark.createDataFrame([("a", 60.0), ("b", 50.0)], "g string, v double")
    assert rows(rp.compare_to_reference(df, "g", "v", {"a": 61.3, "z": 1.0})) == [("a", 60.0, 61.3, -1.3)]


def test_chart_series_drops_total(spark):
    df = spark.createDataFrame([("Total", 1), ("b", 2), ("a", 3)], "g string, v int")
    assert [tuple(r) for r in rp.chart_series(df, "g", ["v"], ["a", "b"]).collect()] == [("a", 3, 1), ("b", 2, 2)]


def test_facets_ignore_their_own_selection(spark, rows):
    df = spark.createDataFrame([("M", "x"), ("M", "y"), ("F", "x"), (None, "x")], "sex string, p string")
    got = da.facet_counts(df, ["sex", "p"], {"sex": ["M"], "p": []})
    assert rows(got) == sorted(
        [("sex", "M", 2), ("sex", "F", 1), ("sex", None, 1), ("p", "x", 1), ("p", "y", 1)], key=repr
    )


def test_empty_filters_admit_everything(spark):
    df = spark.createDataFrame([("M",), (None,)], "sex string")
    assert da.apply_filters(df, {"sex": []}).count() == 2
    assert da.apply_filters(df, {"sex": ["M"]}).count() == 1


def test_histogram_and_scatter(spark, rows):
    df = spark.createDataFrame([(1, 0.4), (2, 0.6), (3, 0.7), (4, None)], "id int, v double")
    assert rows(da.histogram(df, "v", 0.5)) == [(0.0, 1), (0.5, 2), (None, 1)]
    assert da.scatter(df, "id", "v").count() == 4
    some = da.scatter(spark.range(1000).withColumn("y", F.col("id")), "id", "y", "id", 0.1)
    assert 60 < some.count() < 140 and rows(some) == rows(some)
