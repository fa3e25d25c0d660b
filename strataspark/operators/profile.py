"""Profiles of columns and tables, and data-quality checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.scalar import safe_ratio
from strataspark.sources.codes import literal_table


def profile_overview(df: DataFrame, dates: str, categories: str) -> DataFrame:
    """Rows, date range and number of distinct non-null categories."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.min(dates).alias("earliest"),
        F.max(dates).alias("latest"),
        F.countDistinct(categories).alias("n_categories"),
    )


def distribution_stats(df: DataFrame, column: str) -> DataFrame:
    """Count, rounded mean, range and approximate quartiles, in one pass of bounded state."""
    quartiles = F.percentile_approx(column, [0.25, 0.5, 0.75], 10_000)
    return df.agg(
        F.count(column).alias("n"),
        F.round(F.avg(column), 1).alias("mean"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        quartiles.alias("q"),
    ).select(
        "n", "mean", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75")
    )


def describe_column(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """Count, mean, sample standard deviation and range."""
    return df.agg(
        F.count(column).alias("count"),
        F.round(F.avg(column), digits).alias("mean"),
        F.round(F.stddev_samp(column), digits).alias("stddev"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None, limit_pct: float = 10.0) -> DataFrame:
    """Null count and percentage of every column that has nulls, with a verdict on the worst.

    All columns are counted in one aggregation; the rows per column come from
    its single result row.
    """
    names = list(columns or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(names)]
    )
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"), "rows")
        for i, c in enumerate(names)
    ]
    worst = F.array_max(F.array(*[F.col(f"m{i}") for i in range(len(names))]))
    long = wide.withColumn("worst", worst).select(F.inline(F.array(*entries)), "worst")
    pct = F.bround(safe_ratio(F.col("missing_count"), F.col("rows"), 100.0), 2)
    worst_pct = F.bround(safe_ratio(F.col("worst"), F.col("rows"), 100.0), 2)
    return (
        long.filter(F.col("missing_count") > 0)
        .select(
            "column_name",
            "missing_count",
            pct.alias("missing_pct"),
            F.when(worst_pct < limit_pct, F.lit("impute")).otherwise(F.lit("review")).alias("verdict"),
        )
        .orderBy(F.desc("missing_pct"), "column_name")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def cohort_summary(
    df: DataFrame, months: str, event: Column, flags: Mapping[str, Column], age: str, male: Column
) -> DataFrame:
    """One row: size, follow-up range and median, events, flags, mean age, share of men.

    The median is exact over month numbers: an aggregation state of month
    counts, which no number of persons makes large.
    """
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(months).cast("int").alias("min_months"),
        F.max(months).cast("int").alias("max_months"),
        F.percentile(months, 0.5).alias("median_months"),
        F.count_if(event).alias("events"),
        F.round(F.avg(event.cast("int")) * 100, 2).alias("event_pct"),
        *[F.count_if(test).alias(f"{name}_count") for name, test in flags.items()],
        *[F.round(F.avg(test.cast("int")) * 100, 1).alias(f"{name}_pct") for name, test in flags.items()],
        F.round(F.avg(age), 1).alias("mean_age"),
        F.round(F.avg(male.cast("int")) * 100, 1).alias("male_pct"),
    )


def quality_summary(df: DataFrame, numeric: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Row count, numeric ranges and category counts of a table as long rows.

    Each row is unfolded into its checks in the one scan; partial aggregation
    leaves one row per check, value and task before the shuffle.
    """

    def entry(check: str, item: Column, value: Column, how: str) -> Column:
        return F.struct(
            F.lit(check).alias("check"), item.cast("string").alias("item"), value.cast("double").alias("v"), F.lit(how).alias("how")
        )

    none = F.lit(None)
    one = F.lit(1)
    entries = [entry("rows", none, one, "sum")]
    for c in numeric:
        entries.append(entry(f"min_{c}", none, F.col(c), "min"))
        entries.append(entry(f"max_{c}", none, F.col(c), "max"))
    for c in categories:
        entries.append(entry(c, F.col(c), one, "sum"))
    value = (
        F.when(F.col("how") == "min", F.min("v")).when(F.col("how") == "max", F.max("v")).otherwise(F.sum("v"))
    )
    return (
        df.select(F.inline(F.array(*entries)))
        .groupBy("check", "item", "how")
        .agg(value.alias("value"))
        .select("check", "item", "value")
    )


def expect_range(metrics: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Metric rows with their expected band and whether they lie inside it (inclusive).

    A null value fails.  Metrics without a band are not reported.
    """
    spark: SparkSession = metrics.sparkSession
    rows = [(m, None if lo is None else float(lo), None if hi is None else float(hi)) for m, (lo, hi) in bounds.items()]
    bands = literal_table(spark, rows, "metric string, low double, high double")
    inside = (F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (
        F.col("high").isNull() | (F.col("value") <= F.col("high"))
    )
    return metrics.join(bands, "metric").select(
        "metric", "value", "low", "high", F.coalesce(inside, F.lit(False)).alias("passed")
    )


def require(checks: DataFrame) -> DataFrame:
    """The checks unchanged, failing the job when one did not pass."""
    message = F.concat(F.lit("expectation failed: "), F.col("metric"))
    return checks.withColumn("passed", F.when(F.col("passed"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
