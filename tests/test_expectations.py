import re

import pytest
from pyspark.sql import functions as F

from strataspark.session import scratch_path
from strataspark.sources.tables import Expectation, ExpectationFailed, scan_table, write_expected


@pytest.fixture
def target(spark):
    return scratch_path(spark, "expected")


def people(spark, n=100):
    return spark.range(n).select("id", F.when(F.col("id") % 10 == 3, None).otherwise(F.col("id") % 90).alias("age"))


def test_counts_ride_on_the_write(spark, target, rows):
    df = people(spark)
    counts = write_expected(df, target, [Expectation("age known", F.col("age").isNotNull(), 0.1), Expectation("age >= 0", F.col("age") >= 0, 0.2)])
    assert counts == {"rows": 100, "age known": 10, "age >= 0": 10}  # a null test fails
    assert rows(scan_table(spark, target)) == rows(df)


def test_a_failing_expectation_leaves_the_former_table(spark, target, rows):
    write_expected(people(spark), target, [])
    before = rows(scan_table(spark, target))
    with pytest.raises(ExpectationFailed) as caught:
        write_expected(people(spark, 500), target, [Expectation("known", F.col("age").isNotNull(), 0.05), Expectation("id", F.col("id") >= 0)])
    assert caught.value.broken == ["known"] and caught.value.counts == {"rows": 500, "known": 50, "id": 0}
    assert rows(scan_table(spark, target)) == before
    folder = spark._jvm.java.io.File(target).getParentFile()
    name = target.rsplit("/", 1)[1]
    assert [f for f in folder.list() if f.startswith(name)] == [name]  # nothing is left beside it


def test_a_first_table_that_fails_is_not_there(spark, target):
    with pytest.raises(ExpectationFailed):
        write_expected(people(spark), target, [], least_rows=101)
    assert not spark._jvm.java.io.File(target).exists()


def test_a_job_that_dies_leaves_the_former_table(spark, target, rows):
    write_expected(people(spark), target, [])
    before = rows(scan_table(spark, target))
    dying = people(spark).withColumn("age", F.when(F.col("id") == 57, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("age")))
    with pytest.raises(Exception, match="lost"):
        write_expected(dying, target, [Expectation("id", F.col("id") >= 0)])
    assert rows(scan_table(spark, target)) == before


def test_a_table_may_replace_the_one_it_reads(spark, target, rows):
    write_expected(people(spark), target, [], partition_by=["age"])
    kept = scan_table(spark, target).filter("id < 40")
    want = rows(kept, "id")
    assert write_expected(kept, target, [Expectation("id", F.col("id") < 40)])["rows"] == 40
    assert rows(scan_table(spark, target), "id") == want


def test_one_scan_in_the_plan(spark, target):
    source = scratch_path(spark, "source")
    people(spark).write.parquet(source)
    df = spark.read.parquet(source)
    write_expected(df, target, [Expectation("id", F.col("id") >= 0), Expectation("age", F.col("age") < 200, 1.0)])
    observed = df.observe("m", F.count("*").alias("n"), F.count_if(F.col("id") < 0).alias("bad"))
    plan = observed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan and re.search("CollectMetrics", plan)


def test_names_and_targets_are_checked(spark, target):
    with pytest.raises(ValueError):
        write_expected(people(spark), "catalog_name", [])
    with pytest.raises(ValueError):
        write_expected(people(spark), target, [Expectation("rows", F.lit(True))])
