import pytest
from pyspark.sql import functions as F

from strataspark.operators import rates as ra


@pytest.fixture(scope="module")
def people(spark):
    data = [("a", "2", 1, 0), ("a", "2", 0, 0), ("a", "1", 1, 0), ("b", "2", 0, 0), (None, "1", 1, 0), (None, None, None, 0)]
    return spark.createDataFrame(data, "s string, sex string, x int, zero int")


def test_null_stratum_is_not_the_total(people, rows):
    got = ra.rates_with_total(people, "s", ["x", "zero"], ["a", "b"])
    assert rows(got) == sorted(
        [("a", 3, 66.67, 0.0, 1), ("b", 1, 0.0, 0.0, 2), (None, 2, 100.0, 0.0, 4), ("Total", 6, 60.0, 0.0, 3)], key=repr
    )


def test_total_equals_sum_of_strata(people):
    got = ra.rates_with_total(people, "s", ["x"]).collect()
    total = [r["n"] for r in got if r["s"] == "Total"]
    assert total == [sum(r["n"] for r in got if r["s"] != "Total")]


def test_rates_with_total_extends_plain_rates(people, rows):
    plain = ra.stratified_rates(people, "s", ["x", "zero"])
    assert set(rows(plain)) <= set(rows(ra.rates_with_total(people, "s", ["x", "zero"])))


def test_distribution(spark, people, rows):
    population = spark.createDataFrame([("a",)] * 10 + [("b",)] * 4 + [(None,)] * 3 + [("c",)] * 3, "s string")
    got = ra.stratum_distribution(people, population, "s", labels=["a", "b", "c"])
    assert rows(got) == sorted(
        [
            ("a", 3, 50.0, 66.7, 2.0, 30.0, 1),
            ("b", 1, 16.7, 100.0, None, 25.0, 2),
            (None, 2, 33.3, 0.0, 0.0, None, 5),
            ("Total", 6, 100.0, 50.0, 1.5, 30.0, 4),
        ],
        key=repr,
    )


def test_empty_cohort_still_has_a_total(people, rows):
    nobody = people.filter("s = 'none'")
    assert rows(ra.stratum_distribution(nobody, people, "s")) == [("Total", 0, None, None, None, 0.0)]
    assert rows(ra.rates_with_total(nobody, "s", ["x"])) == [("Total", 0, None)]


def test_ratio_of_rounded_or_raw_rates(spark):
    # 1/3 over 2/3: rounded percentages give 33.3 / 66.7 = 0.499, still 0.5
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("a", 0, 0), ("b", 1, 0)], "s string, p int, q int")
    got = {r["s"]: r["ratio"] for r in ra.rates_with_ratio(df, "s", ["p", "q"], "p", "q", "ratio").collect()}
    assert got == {"a": 0.5, "b": None, "Total": 1.0}


def test_ratio_total_option(spark):
    data = [("a", 1, 1)] + [("a", 1, 0)] * 3 + [("a", 0, 0)] * 996
    df = spark.createDataFrame(data, "s string, p int, q int")
    # raw: 0.004 / 0.001 = 4.0, rounded to one digit: 0.4 / 0.1 = 4.0
    for flag in (False, True):
        got = ra.rates_with_ratio(df, "s", ["p", "q"], "p", "q", "r", total_from_rounded=flag).filter("s = 'Total'").first()
        assert got["r"] == 4.0
    thin = spark.createDataFrame([("a", 1, 1)] + [("a", 1, 0)] * 3 + [("a", 0, 0)] * 9996, "s string, p int, q int")
    raw, rounded = (
        ra.rates_with_ratio(thin, "s", ["p", "q"], "p", "q", "r", total_from_rounded=f).filter("s = 'Total'").first()["r"]
        for f in (False, True)
    )
    assert raw == 4.0 and rounded is None


def test_conditional_sums(people, rows):
    got = ra.conditional_sums(people, {"female": F.col("sex") == "2"})
    assert rows(got, "n", "female_count", "female_pct") == [(6, 3, 50.0)]


def test_share_of_total(people):
    got = {r["s"]: r["pct"] for r in ra.share_of_total(people, "s").collect()}
    assert got == {"a": 50.0, "b": 16.7, None: 33.3}


def test_top_k_breaks_ties_by_value(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,), (None,), (None,)], "v string")
    assert [tuple(r) for r in ra.top_k(df, "v", 2).collect()] == [("c", 2), ("a", 1)]
    assert rows(ra.rows_of_top_k(df, "v", 2)) == [("a",), ("c",), ("c",)]


def test_grouped_events_rounds_half_even(spark):
    df = spark.createDataFrame([("g", 1)] * 1 + [("g", 0)] * 799, "g string, e int")
    r = ra.grouped_events(df, "g", "e").first()
    assert (r["n"], r["events"], r["event_rate"], r["event_rate_pct"]) == (800, 1, 0.0012, 0.12)


def test_order_by_ordinal(people):
    table = ra.rates_with_total(people, "s", [])
    assert [r["s"] for r in ra.order_by_ordinal(table, "s", ["b", "a"]).collect()] == ["b", "a", "Total", None]
