"""Counts, shares and rates by stratum, with totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataspark.functions.bands import TOTAL, ordinal
from strataspark.functions.scalar import safe_ratio


def group_count(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def conditional_sums(df: DataFrame, tests: Mapping[str, Column], digits: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Rows, and for every test the number of rows that pass and their percentage."""
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(f"{name}_count") for name, t in tests.items()]
    )
    return counted.withColumns(
        {f"{name}_pct": safe_ratio(F.col(f"{name}_count"), F.col("n"), 100.0, digits) for name in tests}
    )


def rate(total: Column, rows: Column, digits: int | None) -> Column:
    """A mean of 0/1 values as a percentage."""
    return safe_ratio(total, rows, 100.0, digits)


def overall_rates(df: DataFrame, flags: Sequence[str], digits: int = 1, suffix: str = "_pct") -> DataFrame:
    """One wide row of percentages over all rows."""
    return df.agg(*[F.round(F.avg(f) * 100, digits).alias(f + suffix) for f in flags])


def stratified_rates(df: DataFrame, stratum: str, flags: Sequence[str], digits: int = 2) -> DataFrame:
    """Members and flag percentages per stratum; a null stratum is a row of its own."""
    return df.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f) * 100, digits).alias(f) for f in flags]
    )


def _stratum_sums(df: DataFrame, stratum: str, flags: Sequence[str]) -> DataFrame:
    """Sums per stratum, then a total added from those few rows.

    The raw rows are aggregated once.  Rolling up afterwards works on one row
    per stratum, where rolling up the raw rows would double them first.  One
    row of zeros joins the strata, so that an empty input has a total as well.
    """
    per_stratum = df.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f).cast("long")).alias(f"s_{f}") for f in flags],
        *[F.count(f).alias(f"c_{f}") for f in flags],
    )
    none, zero = F.lit(None), F.lit(0).cast("long")
    nobody = df.sparkSession.range(1).select(
        none.cast(df.schema[stratum].dataType).alias(stratum),
        zero.alias("n"),
        *[none.cast("long").alias(f"s_{f}") for f in flags],
        *[zero.alias(f"c_{f}") for f in flags],
    )
    rolled = per_stratum.unionByName(nobody).rollup(stratum).agg(
        F.grouping_id().alias("is_total"),
        F.sum("n").alias("n"),
        *[F.sum(f"s_{f}").alias(f"s_{f}") for f in flags],
        *[F.sum(f"c_{f}").alias(f"c_{f}") for f in flags],
    )
    # A stratum without members is the row of zeros alone.
    return rolled.filter((F.col("is_total") == 1) | (F.col("n") > 0))


def _labelled(df: DataFrame, stratum: str) -> Column:
    """The stratum, or the total's label; a null stratum stays null and is no total."""
    return F.when(df["is_total"] == 1, F.lit(TOTAL)).otherwise(df[stratum])


def rates_with_total(
    df: DataFrame,
    stratum: str,
    flags: Sequence[str],
    labels: Sequence[str] | None = None,
    digits: int = 2,
) -> DataFrame:
    """Flag percentages per stratum and over all rows, in one scan.

    With ``labels`` a ``sort_key`` column gives the display order, since stored
    tables keep none.
    """
    sums = _stratum_sums(df, stratum, flags)
    out = sums.select(
        _labelled(sums, stratum).alias(stratum),
        "n",
        *[rate(F.col(f"s_{f}"), F.col(f"c_{f}"), digits).alias(f) for f in flags],
    )
    return out.withColumn("sort_key", ordinal(F.col(stratum), labels)) if labels else out


def rates_with_ratio(
    df: DataFrame,
    stratum: str,
    flags: Sequence[str],
    numerator: str,
    denominator: str,
    ratio: str,
    labels: Sequence[str] | None = None,
    digits: int = 1,
    total_from_rounded: bool = False,
) -> DataFrame:
    """Rates with a total and the ratio of two of them.

    Stratum rows divide the rounded percentages.  The total divides the raw
    means, or the rounded percentages too when ``total_from_rounded`` is set.
    """
    sums = _stratum_sums(df, stratum, flags)
    pct = {f: rate(F.col(f"s_{f}"), F.col(f"c_{f}"), digits) for f in flags}
    rounded = safe_ratio(pct[numerator], pct[denominator], digits=1)
    means = [safe_ratio(F.col(f"s_{f}"), F.col(f"c_{f}")) for f in (numerator, denominator)]
    raw = safe_ratio(means[0], means[1], digits=1)
    whole = rounded if total_from_rounded else raw
    out = sums.select(
        _labelled(sums, stratum).alias(stratum),
        "n",
        *[expr.alias(f) for f, expr in pct.items()],
        F.when(F.col("is_total") == 1, whole).otherwise(rounded).alias(ratio),
    )
    return out.withColumn("sort_key", ordinal(F.col(stratum), labels)) if labels else out


def stratum_distribution(
    cohort: DataFrame,
    population: DataFrame,
    stratum: str,
    sex: str = "sex",
    female: str = "2",
    male: str = "1",
    labels: Sequence[str] | None = None,
    published: DataFrame | None = None,
) -> DataFrame:
    """Members, share, female percentage, sex ratio and prevalence per stratum, with a total.

    Both inputs are reduced to one row per stratum before they meet.  A null
    stratum has no prevalence, since a null key matches nothing; the total's
    population is everybody.
    """
    marked = cohort.select(
        stratum,
        (F.col(sex) == female).cast("int").alias("female"),
        (F.col(sex) == male).cast("int").alias("male"),
    )
    members = _stratum_sums(marked, stratum, ["female", "male"])
    people = _stratum_sums(population.select(stratum), stratum, [])
    named = members.select(_labelled(members, stratum).alias(stratum), "is_total", "n", "s_female", "s_male")
    pop = people.select(
        _labelled(people, stratum).alias(stratum), "is_total", F.col("n").alias("n_pop")
    )
    # One row per stratum is left here, so this window sees a handful of rows.
    whole = F.max(F.when(F.col("is_total") == 1, F.col("n"))).over(Window.partitionBy())
    out = named.join(pop, [stratum, "is_total"], "left").select(
        stratum,
        "n",
        safe_ratio(F.col("n"), whole, 100.0, 1).alias("pct_of_total"),
        safe_ratio(F.coalesce("s_female", F.lit(0)), F.col("n"), 100.0, 1).alias("female_pct"),
        safe_ratio(F.coalesce("s_female", F.lit(0)), F.col("s_male"), digits=2).alias("fm_ratio"),
        safe_ratio(F.col("n"), F.col("n_pop"), 100.0, 2).alias("prevalence"),
    )
    if published is not None:
        out = out.join(published, stratum, "left")
    return out.withColumn("sort_key", ordinal(F.col(stratum), labels)) if labels else out


def grouped_events(df: DataFrame, by: str, event: str) -> DataFrame:
    """Members, events and event rate per group, largest group first.

    The rate is rounded half-even to four digits before it becomes a percentage.
    """
    mean = F.bround(F.avg(event), 4)
    return (
        df.groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(event).cast("long").alias("events"), mean.alias("event_rate"))
        .withColumn("event_rate_pct", F.bround(F.col("event_rate") * 100, 2))
        .orderBy(F.desc("n"), by)
    )


def share_of_total(df: DataFrame, by: str, digits: int = 1) -> DataFrame:
    """Rows per group and their percentage of all rows.

    The total is a scalar subquery over a column-free scan, not a window over
    all groups, so a column with very many values stays parallel.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    return group_count(df, [by]).withColumn("pct", safe_ratio(F.col("n"), total, 100.0, digits))


def order_by_ordinal(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Rows in the order of a label list, the total last."""
    return df.orderBy(ordinal(F.col(column), labels), column)


def order_by_desc(df: DataFrame, measure: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(measure), tie)


def top_k(df: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties broken by value; null is not a value."""
    counted = group_count(df.filter(F.col(by).isNotNull()), [by])
    return counted.orderBy(F.desc("n"), by).limit(k)


def rows_of_top_k(df: DataFrame, by: str, k: int) -> DataFrame:
    """Rows whose value is among the ``k`` most frequent ones."""
    return df.join(top_k(df, by, k).select(by), by, "left_semi")
