import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from strataspark.operators import joins as jo


@pytest.fixture(scope="module")
def skewed(spark):
    """Facts of which one key holds a third and another one a twentieth; keys below 0.1 % hold the rest."""
    facts = spark.range(60_000).select(
        F.col("id").alias("line"),
        F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 20 == 1, F.lit(-2)).when(F.col("id") % 1000 == 7, None).otherwise(F.col("id") % 9001).alias("k"),
    )
    claims = facts.select("k").distinct().withColumn("owner", F.concat(F.lit("o"), F.col("k").cast("string")))
    return facts, claims


def test_sketch_finds_the_hot_keys_and_their_pieces(skewed):
    facts, _ = skewed
    hot = {r.k: r.pieces for r in jo.hot_keys(jo.key_sketch(facts, "k"), "k", 0.01).collect()}
    assert set(hot) == {-1, -2} and 33 <= hot[-1] <= 35 and 3 <= hot[-2] <= 6


def test_sketches_of_parts_merge(skewed):
    facts, _ = skewed
    parts = [jo.key_sketch(facts.filter(F.col("line") % 4 == i), "k") for i in range(4)]
    merged = jo.merge_key_sketches(parts)
    assert merged.first()["n"] == facts.filter("k IS NOT NULL").count()
    whole = {r.k: r.pieces for r in jo.hot_keys(jo.key_sketch(facts, "k"), "k", 0.01).collect()}
    assert {r.k: r.pieces for r in jo.hot_keys(merged, "k", 0.01).collect()} == whole


@pytest.mark.parametrize("share", [0.2, 0.01, 0.001])
def test_rows_equal_the_plain_join(skewed, rows, share):
    facts, claims = skewed
    assert rows(jo.join_hot(facts, claims, "k", ["line"], share=share), "line", "k", "owner") == rows(facts.join(claims, "k"), "line", "k", "owner")


def test_largest_task_is_bounded(spark, skewed):
    facts, claims = skewed
    asked = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "50"}
    former = {c: spark.conf.get(c) for c in asked}
    for c, v in asked.items():
        spark.conf.set(c, v)
    try:
        def largest(df):
            return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

        plain = largest(facts.join(claims, "k"))
        dealt = largest(jo.join_hot(facts, claims, "k", ["line"], share=0.005))
        plan = plan_of(jo.join_hot(facts, claims, "k", ["line"], share=0.005))
    finally:
        for c, v in former.items():
            spark.conf.set(c, v)
    assert plain > 20_000 and dealt < 4_000  # an even part is 1,200 rows, a piece 300
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") <= 2


def test_only_hot_claims_are_repeated(skewed):
    facts, claims = skewed
    hot = jo.hot_keys(jo.key_sketch(facts, "k"), "k", 0.01)
    copies = claims.join(hot, "k", "left").select(F.sum(F.coalesce("pieces", F.lit(1)))).first()[0]
    assert copies < claims.count() + 50


def test_no_hot_key_and_no_rows(spark, rows):
    rng = random.Random(1)
    facts = spark.createDataFrame([(i, rng.randint(0, 5000)) for i in range(5000)], "line long, k long")
    claims = facts.select("k").distinct()
    assert jo.join_hot(facts, claims, "k", ["line"], share=0.05).count() == 5000
    assert jo.join_hot(facts.limit(0), claims, "k", ["line"]).count() == 0
    with pytest.raises(ValueError):
        jo.join_hot(facts, claims, "k", [])


def test_panel_of_240_months(spark, rows):
    people = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    months = jo.month_list("200001", "201912")
    activity = spark.createDataFrame(
        [("a", months[i % 240]) for i in range(0, 960, 5)] + [("a", "199912"), ("a", "202001"), ("c", "200001"), ("a", None)], "k string, service_month string"
    )
    panel = jo.activity_panel(people, activity, "k", "200001", "201912")
    got = {(r.k, r.service_month): r.n for r in panel.collect()}
    assert len(got) == 3 * 240 and panel.count() == 3 * 240
    want = {m: 0 for m in months}
    for i in range(0, 960, 5):
        want[months[i % 240]] += 1
    assert {m: got["a", m] for m in months} == want
    assert all(got[k, m] == 0 for k in ("b", None) for m in months)
    plan = plan_of(jo.activity_panel(people, activity, "k", "200001", "201912"))
    # One count over (entity, month), whatever the number of months, and the list of months is unfolded in generated code.
    assert "count_if" not in plan and plan.count("partial_count(1)") == 1 and "200001" in plan
    assert any("Generate" in str(stage) for stage in panel._jdf.queryExecution().executedPlan().toString().split("\n") if "*(" in stage)
