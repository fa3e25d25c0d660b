import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import plan_of, ranges

from strataspark.functions.stats import Z_95
from strataspark.operators import survival as su


def frame(spark, people):
    return spark.createDataFrame(people, "g string, t int, e int")


def brute_curve(people):
    """Survival by definition: at every time, count who is still there and who has the event."""
    times = sorted({t for t, _ in people})
    s, green, out = 1.0, 0.0, []
    for t in times:
        n = sum(1 for u, _ in people if u >= t)
        d = sum(1 for u, e in people if u == t and e)
        s *= 1 - d / n
        green += d / (n * (n - d)) if n > d else 0.0
        out.append((t, n, d, s, green))
    return out


def brute_logrank(a, b):
    times = sorted({t for t, _ in a + b})
    o = e = v = 0.0
    for t in times:
        n1, n2 = (sum(1 for u, _ in g if u >= t) for g in (a, b))
        d1, d2 = (sum(1 for u, x in g if u == t and x) for g in (a, b))
        n, d = n1 + n2, d1 + d2
        o += d1
        e += d * n1 / n
        v += d * (n1 / n) * (n2 / n) * (n - d) / (n - 1) if n > 1 else 0.0
    return o, e, v


def sample(seed, size=120):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randint(0, 30), int(rng.random() < 0.6)) for _ in range(size)]


@pytest.mark.parametrize("n", [1, 3, 16])
@pytest.mark.parametrize("origin", [True, False])
def test_curve_matches_definition(spark, n, origin):
    people = [p for p in sample(1) if p[1] > 0]
    with ranges(spark, n):
        got = su.kaplan_meier(frame(spark, people), "t", "e", ["g"], origin=origin).collect()
    if origin:
        assert {(r["g"], r["survival"]) for r in got if r["t"] == 0} == {("a", 1.0), ("b", 1.0)}
        got = [r for r in got if r["t"] > 0]
    for g in "ab":
        want = brute_curve([(t, e) for h, t, e in people if h == g])
        mine = sorted((r["t"], r["n_at_risk"], r["n_events"], r["survival"]) for r in got if r["g"] == g)
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        assert [m[3] for m in mine] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_ties_and_at_risk(spark):
    people = [("a", 1, 1), ("a", 1, 0), ("a", 2, 1), ("a", 2, 1), ("a", 3, 0)]
    got = [tuple(r) for r in su.event_table(frame(spark, people), "t", "e", ["g"]).orderBy("t").collect()]
    assert got == [("a", 1, 5, 1, 1), ("a", 2, 3, 2, 0), ("a", 3, 1, 0, 1)]


def test_everybody_dies(spark):
    people = [("a", 1, 1), ("a", 2, 1), ("a", 2, 1)]
    band = su.km_confidence(su.kaplan_meier(frame(spark, people), "t", "e")).orderBy("t").collect()
    assert [r["t"] for r in band] == [0, 1, 2]
    assert band[-1]["survival"] == 0.0
    assert band[-1]["ci_lower"] is None and band[0]["ci_upper"] is None


def test_nobody_dies(spark):
    people = [("a", 1, 0), ("b", 2, 0), ("a", 3, 0)]
    curve = su.kaplan_meier(frame(spark, people), "t", "e").collect()
    assert {r["survival"] for r in curve} == {1.0}
    test = su.logrank_pvalue(su.logrank_test(frame(spark, people), "t", "e", "g", "a", "b")).first()
    assert test["variance"] == 0.0 and test["chi2"] is None and test["p_value"] is None


def test_origin_row_only_where_missing(spark):
    people = [("a", 0, 1), ("a", 4, 0), ("b", 3, 1)]
    got = su.kaplan_meier(frame(spark, people), "t", "e", ["g"]).orderBy("g", "t").collect()
    assert [(r["g"], r["t"], r["n_at_risk"], r["n_events"]) for r in got] == [
        ("a", 0, 2, 1), ("a", 4, 1, 0), ("b", 0, 1, 0), ("b", 3, 1, 1),
    ]
    assert got[2]["survival"] == 1.0


def test_band_encloses_curve(spark):
    people = sample(3)
    for r in su.km_confidence(su.kaplan_meier(frame(spark, people), "t", "e", ["g"])).collect():
        if r["ci_lower"] is not None:
            assert 0 <= r["ci_lower"] <= r["survival"] <= r["ci_upper"] <= 1


def test_band_value(spark):
    people = [("a", 1, 1)] + [("a", 2, 0)] * 9
    r = su.km_confidence(su.kaplan_meier(frame(spark, people), "t", "e", origin=False)).filter("t = 1").first()
    s, var = 0.9, 1 / (10 * 9)
    width = Z_95 * math.sqrt(var) / math.log(s)
    assert r["ci_lower"] == pytest.approx(math.exp(-math.exp(math.log(-math.log(s)) - width)))
    assert r["ci_upper"] == pytest.approx(math.exp(-math.exp(math.log(-math.log(s)) + width)))


@pytest.mark.parametrize("n", [1, 7])
def test_logrank_matches_definition(spark, n):
    people = sample(7)
    a, b = ([(t, e) for h, t, e in people if h == g] for g in "ab")
    o, e, v = brute_logrank(a, b)
    with ranges(spark, n):
        got = su.logrank_pvalue(su.logrank_test(frame(spark, people), "t", "e", "g", "a", "b")).first()
    assert got["observed"] == o
    assert got["expected"] == pytest.approx(e, abs=1e-10)
    assert got["variance"] == pytest.approx(v, abs=1e-10)
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt((o - e) ** 2 / v / 2)), rel=1e-6)


def test_expected_sums_to_observed(spark):
    df = frame(spark, sample(9))
    tests = [su.logrank_test(df, "t", "e", "g", x, y).first() for x, y in (("a", "b"), ("b", "a"))]
    assert sum(t["expected"] for t in tests) == pytest.approx(sum(t["observed"] for t in tests))
    assert tests[0]["chi2"] == pytest.approx(tests[1]["chi2"])


def test_subgroups_equal_separate_tests(spark):
    people = [(g, t, e, "x" if t % 2 else "y") for g, t, e in sample(11)]
    df = spark.createDataFrame(people, "g string, t int, e int, s string")
    joint = {r["s"]: r["chi2"] for r in su.subgroup_logrank(df, "t", "e", "g", "a", "b", "s").collect()}
    for s in "xy":
        alone = su.logrank_test(df.filter(F.col("s") == s), "t", "e", "g", "a", "b").first()["chi2"]
        assert joint[s] == pytest.approx(alone)


def test_null_group_is_kept_in_ranges(spark):
    people = [(None, 1, 1), (None, 5, 0), ("a", 2, 1)]
    with ranges(spark, 4):
        got = su.event_table(frame(spark, people), "t", "e", ["g"]).collect()
    assert {(r["g"], r["t"], r["n_at_risk"]) for r in got} == {(None, 1, 2), (None, 5, 1), ("a", 2, 1)}


def test_millions_of_distinct_times_equal_one_window(spark):
    # Ninety per cent of the times lie in a thousandth of the span, and one group holds nearly all persons.
    people = spark.range(1_500_000).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("large").alias("g"),
        (F.when(F.col("id") % 10 == 0, F.col("id") * 1.0).otherwise(F.col("id") / 1500.0) + 0.25).alias("t"),
        (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("e"),
    )
    with ranges(spark, 24):
        got = su.kaplan_meier(people, "t", "e", ["g"], origin=False)
        seen = got.agg(F.count("*"), F.sum("survival"), F.sum("greenwood"), F.sum("n_at_risk"), F.min("survival")).first()
        per = su.in_ranges(people.select("g", "t"), ["g"], "t").groupBy(su.RANGE).count().collect()
    assert len(per) >= 20 and max(r["count"] for r in per) < 3 * 1_500_000 / 24
    w = Window.partitionBy("g").orderBy("t")
    risk = people.withColumn("n", F.count("*").over(w.orderBy(F.desc("t"))))
    alive = F.col("n") - F.col("e")
    logs = F.sum(F.when(alive > 0, F.log1p(-F.col("e") / F.col("n"))).otherwise(0)).over(w)
    ended = F.max((alive == 0).cast("int")).over(w)
    green = F.sum(F.when(alive > 0, F.col("e") / F.col("n") / alive).otherwise(0)).over(w)
    whole = risk.select("n", F.when(ended == 1, 0.0).otherwise(F.exp(logs)).alias("s"), green.alias("green"))
    want = whole.agg(F.count("*"), F.sum("s"), F.sum("green"), F.sum("n"), F.min("s")).first()
    assert tuple(seen) == pytest.approx(tuple(want), rel=1e-9)


def test_no_window_sees_all_times_of_a_group(spark):
    plan = plan_of(su.kaplan_meier(frame(spark, sample(2)), "t", "e", ["g"]))
    for line in re.findall(r"Window \[([^\n]*)", plan):
        # Either within a range, or over totals of ranges.
        assert re.search(rf"\[g#\d+, {su.RANGE}#\d+\]", line) or re.search(rf"\[g#\d+\], \[{su.RANGE}#\d+ ", line), line


def test_patterns_take_the_k_largest(spark):
    people = [("a", 1, 1)] * 3 + [("b", 2, 0)] * 2 + [("c", 3, 1)] + [(None, 4, 1)] * 9
    got = su.km_by_pattern(frame(spark, people), "t", "e", "g", 2)
    assert {(r["g"], r["n"], r["events"]) for r in got.collect()} == {("a", 3, 3), ("b", 2, 0)}


def test_rate_ratio(spark):
    df = spark.createDataFrame([(True, 1), (True, 1), (True, 0), (False, 1), (False, 0), (False, 0)], "x boolean, e int")
    r = su.event_rate_ratio(df, F.col("x"), "e").first()
    assert (r["rate_unexposed"], r["rate_exposed"], r["rate_ratio"]) == (33.33, 66.67, 2.0)
