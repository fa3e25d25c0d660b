import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from strataspark.operators import profile_states as ps
from strataspark.session import scratch_path

COLUMNS = ["amount", "count", "label", "empty"]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(40_000).select(
        "id",
        F.when(F.col("id") % 11 == 0, None).otherwise(1e9 + F.pmod(F.xxhash64("id"), F.lit(100_000)) / 7).alias("amount"),
        (F.col("id") % 500).cast("int").alias("count"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), F.col("id") % 3000)).alias("label"),
        F.lit(None).cast("double").alias("empty"),
        F.concat(F.lit("2024-01-0"), F.col("id") % 4 + 1).alias("day"),
    )
    path = scratch_path(spark, "table")
    df.write.partitionBy("day").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def stored(spark, table):
    path = scratch_path(spark, "states")
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"):
        ps.store_states(table.filter(F.col("day") == day), path, day, COLUMNS)
    return path


def by_column(df):
    return {r.column_name: r for r in df.collect()}


def test_merged_equals_recomputed(spark, table, stored):
    merged, whole = by_column(ps.stored_profile(spark, stored)), by_column(ps.profile_of(ps.column_states(table, COLUMNS)))
    for c in COLUMNS:
        for name in ("rows", "n", "nulls", "null_pct", "min", "max"):
            assert merged[c][name] == whole[c][name], (c, name)
        for name in ("mean", "std"):
            assert merged[c][name] == (None if whole[c][name] is None else pytest.approx(whole[c][name], rel=1e-9)), (c, name)


def test_estimates_keep_their_bounds(spark, table, stored):
    merged = by_column(ps.stored_profile(spark, stored))
    for c in ("amount", "count", "label"):
        exact = table.agg(F.countDistinct(c)).first()[0]
        assert abs(merged[c].distinct_estimate - exact) <= 0.03 * exact
    assert merged["empty"].distinct_estimate == 0 and merged["empty"].p50 is None and merged["label"].p50 is None
    for c in ("amount", "count"):
        n = table.filter(F.col(c).isNotNull()).count()
        for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
            below = table.filter(F.col(c) < merged[c][name]).count()
            upto = table.filter(F.col(c) <= merged[c][name]).count()
            assert below - 0.01 * n <= q * n <= upto + 0.01 * n


def test_only_new_parts_are_read(spark, table, stored):
    plan = plan_of(ps.stored_profile(spark, stored))
    assert plan.count("FileScan parquet") == 1 and "amount" not in plan
    two = by_column(ps.stored_profile(spark, stored, ["2024-01-01", "2024-01-03"]))
    assert two["count"].rows == table.filter("day IN ('2024-01-01', '2024-01-03')").count()


def test_a_part_again_replaces_that_part(spark, table, stored):
    before = by_column(ps.stored_profile(spark, stored))
    ps.store_states(table.filter("day = '2024-01-02'"), stored, "2024-01-02", COLUMNS)
    after = by_column(ps.stored_profile(spark, stored))
    assert {c: (r.rows, r.n, r.min, r.max) for c, r in before.items()} == {c: (r.rows, r.n, r.min, r.max) for c, r in after.items()}


def test_an_empty_part_changes_nothing(spark, table, stored):
    states = ps.column_states(table, COLUMNS).unionByName(ps.column_states(table.limit(0), COLUMNS))
    merged, whole = by_column(ps.profile_of(ps.merged_states(states))), by_column(ps.profile_of(ps.column_states(table, COLUMNS)))
    assert {c: r[:9] for c, r in merged.items()} == {c: r[:9] for c, r in whole.items()}
    nothing = by_column(ps.profile_of(ps.column_states(table.limit(0), COLUMNS)))
    assert nothing["count"].rows == 0 and nothing["count"].mean is None and nothing["count"].null_pct is None
