import hashlib
import re

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from strataspark.functions.hashing import keyed_uniform
from strataspark.operators import sampling as sa


@pytest.fixture(scope="module")
def skewed(spark):
    # one key holds a third of the rows
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).cast("int").alias("k")
    )


def test_number_and_column_pick_the_same_rows(skewed, rows):
    fixed = rows(sa.pick_n_per_key(skewed, "k", "id", "s", 4))
    assert rows(sa.pick_n_per_key(skewed, "k", "id", "s", F.lit(4))) == fixed


def test_per_key_n(skewed):
    picked = sa.pick_n_per_key(skewed, "k", "id", "s", F.col("k") % 3)
    assert {(r["k"], r["n"]) for r in picked.groupBy("k").agg(F.count("*").alias("n")).collect()} == {
        (k, k % 3) for k in range(50) if k % 3
    }


def brute_picks(rows, n):
    """Rank by rank, from the hash itself."""
    by_key = {}
    for i, k in rows:
        draw = int(hashlib.md5(f"{i}|s".encode()).hexdigest()[:8], 16)
        by_key.setdefault(k, []).append((draw, i))
    return sorted(((k, i, p) for k, held in by_key.items() for p, (_, i) in enumerate(sorted(held), 1) if p <= n), key=repr)


@pytest.mark.parametrize("n", [0, 1, 500, 900, 1001, 5000])
def test_any_n_equals_ranking_whole_keys(skewed, n):
    picked = sa.pick_n_per_key(skewed, "k", "id", "s", n)
    want = brute_picks([(r.id, r.k) for r in skewed.collect()], n)
    assert sorted(((r.k, r.id, r.pick) for r in picked.collect()), key=repr) == want


def test_null_keys_and_null_n(spark):
    df = spark.createDataFrame([(i, None if i % 2 else i % 5) for i in range(400)], "id long, k int")
    picked = sa.pick_n_per_key(df, "k", "id", "s", 30)
    assert sorted(((r.k, r.id, r.pick) for r in picked.collect()), key=repr) == brute_picks([tuple(r) for r in df.collect()], 30)
    assert sa.pick_n_per_key(df, "k", "id", "s", F.lit(None).cast("int")).count() == 0
    assert sa.pick_n_per_key(df, "k", "id", "s", -1).count() == 0
    assert sa.pick_n_per_key(df.limit(0), "k", "id", "s", 3).count() == 0


def test_rows_are_ranked_by_key_and_part_only(skewed):
    plan = plan_of(sa.pick_n_per_key(skewed, "k", "id", "s", 500))
    windows = re.findall(r"Window \[([^\n]*)", plan)
    ranking = [w for w in windows if "row_number" in w]
    assert len(ranking) == 1 and re.search(r"\[__k#\d+, __part#\d+\]", ranking[0])
    # The other one adds up counts: below it, rows are aggregated already.
    adding = plan.index("sum(__held")
    assert "HashAggregate" in plan[adding:] and len(windows) == 2


def test_half_of_a_hot_key_is_ranked_in_small_tasks(spark):
    # One key holds 90 % of the rows and gives half of them.
    hot = spark.range(60_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"))
    drawn = hot.select("id", F.struct("k").alias("__k"), F.floor(keyed_uniform(F.col("id"), "s") * sa.PARTS).cast("int").alias("__part"))
    most = drawn.groupBy("__k", "__part").count().agg(F.max("count")).first()[0]
    assert most <= 60  # of 54,000 rows of the key
    picked = sa.pick_n_per_key(hot, "k", "id", "s", 27_000).filter("k = -1")
    assert picked.count() == 27_000 and picked.agg(F.max("pick")).first()[0] == 27_000
    assert picked.select("pick").distinct().count() == 27_000


def test_sample_does_not_depend_on_partitions(skewed, rows):
    one = rows(sa.hash_sample(skewed, F.col("id"), "s", 0.2))
    assert rows(sa.hash_sample(skewed.repartition(7), F.col("id"), "s", 0.2)) == one
    assert 450 < len(one) < 750


def test_explode_n(spark, rows):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, None), (4, -1), (5, 1)], "id int, n int")
    assert rows(sa.explode_n(df, F.col("n")), "id", "seq") == [(1, 1), (1, 2), (5, 1)]
