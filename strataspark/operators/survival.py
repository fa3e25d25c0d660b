"""Survival analysis as aggregations: event tables, curves, bands and log-rank tests.

Persons are reduced to one row per group and time before anything is ordered.
Running sums over these rows are prefix sums by ranges: the rows are
range-partitioned by group and time and stored with the number of their range
(:func:`in_ranges`); totals per range are added up along the ranges, sums
inside a range along its times, and the two are put together.  No task sees
all times of a group, however fine they are and however they lie, and no
caller has to choose an interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataspark.functions.scalar import safe_ratio
from strataspark.functions.stats import Z_95, chi2_upper_tail_df1, significance
from strataspark.session import scratch_path

RANGE = "__range"


def in_ranges(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Stored: ``df`` with ``RANGE``, the number of the range of ``by`` and ``order`` that a row lies in.

    Ranges follow each other in order.  Their bounds come from Spark's own
    sampling, so ranges hold about the same number of rows; the number is
    stored, since another run might draw other bounds.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranges")
    dealt = df.repartitionByRange(*by, order).withColumn(RANGE, F.spark_partition_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def running_sums(
    df: DataFrame, by: Sequence[str], order: str, sums: dict[str, Column], descending: bool = False
) -> DataFrame:
    """Running sums within ``by`` along ``order`` over rows already unique in both.

    Rows that come :func:`in_ranges` keep their ranges, so several sums in a
    row deal them out once; others are put in ranges first, and the result is
    without them.
    """
    if RANGE not in df.columns:
        return running_sums(in_ranges(df, by, order), by, order, sums, descending).drop(RANGE)
    toward = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    keys = [*by, RANGE]
    # As many rows a group as it has ranges.
    outer = Window.partitionBy(*by).orderBy(toward(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*keys).orderBy(toward(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys).agg(*[F.sum(expr).alias(f"__{name}") for name, expr in sums.items()])
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"__{name}").over(outer), F.lit(0)).alias(f"__{name}") for name in sums],
    )
    matches = [df[k].eqNullSafe(offsets[f"__k_{k}"]) for k in keys]
    joined = df.join(offsets, matches)
    added = joined.withColumns({name: F.sum(expr).over(inner) + F.col(f"__{name}") for name, expr in sums.items()})
    return added.drop(*[f"__{n}" for n in sums], *[f"__k_{k}" for k in keys])


def _leaving(df: DataFrame, time: str, event: str, by: Sequence[str]) -> DataFrame:
    """Persons and events per group and time; the one pass over the persons."""
    return df.groupBy(*by, F.col(time).alias("t")).agg(
        F.count(F.lit(1)).alias("leaving"), F.sum(F.col(event).cast("long")).alias("n_events")
    )


def _at_risk(leaving: DataFrame, by: Sequence[str]) -> DataFrame:
    """Persons at risk, events and censored persons, in ranges."""
    known = in_ranges(leaving.filter(F.col("t").isNotNull()), by, "t")
    at_risk = running_sums(known, by, "t", {"n_at_risk": F.col("leaving")}, descending=True)
    return at_risk.select(
        *by, "t", "n_at_risk", "n_events", (F.col("leaving") - F.col("n_events")).alias("n_censored"), RANGE
    )


def event_table(df: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group and time: persons at risk, events and censored persons.

    Persons without a time are left out.
    """
    return _at_risk(_leaving(df, time, event, by), by).drop(RANGE)


def with_origin(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add a row at time 0 to groups that have none, with everybody at risk.

    One aggregated row per group, its first time and the most at risk, becomes
    the row; it joins the range of the group's first time.
    """
    zero = F.lit(0).cast(events.schema["t"].dataType)
    nobody = F.lit(0).cast("long")
    ranges = [RANGE] if RANGE in events.columns else []
    firsts = events.groupBy(*by).agg(
        F.min("t").alias("__first"), F.max("n_at_risk").alias("n_at_risk"), *[F.min(r).alias(r) for r in ranges]
    )
    starts = firsts.filter(F.col("__first") > 0).select(
        *by, zero.alias("t"), "n_at_risk", nobody.alias("n_events"), nobody.alias("n_censored"), *ranges
    )
    return events.select(*starts.columns).unionByName(starts)


def kaplan_meier(
    df: DataFrame,
    time: str,
    event: str,
    by: Sequence[str] = (),
    origin: bool = True,
) -> DataFrame:
    """Survival per group and time: the running product of ``1 - events / at risk``.

    The product is a sum of logarithms; the one factor without a logarithm is
    zero, at the time the last persons at risk all have the event, and makes
    the curve zero from there on.
    """
    return _curve(_at_risk(_leaving(df, time, event, by), by), by, origin)


def _curve(events: DataFrame, by: Sequence[str], origin: bool) -> DataFrame:
    if origin:
        events = with_origin(events, by)
    alive = F.col("n_at_risk") - F.col("n_events")
    step = F.when(alive > 0, F.log1p(-F.col("n_events") / F.col("n_at_risk"))).otherwise(F.lit(0.0))
    # Divided twice: the product of two counts can pass the largest integer.
    spread = F.when(alive > 0, F.col("n_events") / F.col("n_at_risk") / alive).otherwise(F.lit(0.0))
    summed = running_sums(
        events, by, "t",
        {"__log": step, "greenwood": spread, "__ended": (alive == 0).cast("int")},
    )
    survival = F.when(F.col("__ended") > 0, F.lit(0.0)).otherwise(F.exp("__log"))
    return summed.withColumn("survival", survival).drop("__log", "__ended", RANGE)


def km_confidence(curve: DataFrame, z: float = Z_95) -> DataFrame:
    """Pointwise band on the log(-log) scale with Greenwood's variance; null where S is 0 or 1."""
    s = F.col("survival")
    inside = (s > 0) & (s < 1) & (F.col("greenwood") > 0)
    log_s = F.log(s)
    width = F.lit(z) * F.sqrt("greenwood") / log_s
    centre = F.log(-log_s)
    # log_s is negative: adding the width lowers the exponent's argument.
    lower = F.exp(-F.exp(centre - width))
    upper = F.exp(-F.exp(centre + width))
    return curve.withColumns({"ci_lower": F.when(inside, lower), "ci_upper": F.when(inside, upper)})


def logrank_test(
    df: DataFrame,
    time: str,
    event: str,
    group: str,
    first: object,
    second: object,
    by: Sequence[str] = (),
) -> DataFrame:
    """Two-group log-rank test, optionally within strata: O, E, V, chi-squared.

    Both groups are counted side by side per time, so the union of their event
    times needs no join, and a reverse running sum gives both risk sets.
    """
    in_first, happened = F.col(group) == F.lit(first), F.col(event) == 1
    per_time = (
        df.filter(F.col(time).isNotNull() & F.col(group).isin(first, second))
        .groupBy(*by, F.col(time).alias("t"))
        .agg(
            F.count(F.lit(1)).alias("leaving"),
            F.count_if(in_first).alias("leaving1"),
            F.count_if(happened).alias("d"),
            F.count_if(in_first & happened).alias("d1"),
        )
    )
    risk = running_sums(
        per_time, by, "t", {"n": F.col("leaving"), "n1": F.col("leaving1")}, descending=True
    )
    share = F.col("n1") / F.col("n")
    # try_divide: a single person at risk contributes no variance
    spare = F.coalesce(F.try_divide(F.col("n") - F.col("d"), F.col("n") - 1), F.lit(0.0))
    sums = risk.groupBy(*by).agg(
        F.sum("d1").alias("observed"),
        F.sum(F.col("d") * share).alias("expected"),
        F.sum(F.col("d") * share * (1 - share) * spare).alias("variance"),
    )
    gap = F.col("observed") - F.col("expected")
    return sums.withColumn("chi2", F.try_divide(gap * gap, F.col("variance")))


def logrank_pvalue(test: DataFrame) -> DataFrame:
    """Add the p-value of a log-rank test and its verdict."""
    return test.withColumn("p_value", chi2_upper_tail_df1(F.col("chi2"))).withColumn(
        "verdict", significance(F.col("p_value"))
    )


def km_by_pattern(df: DataFrame, time: str, event: str, pattern: str, k: int = 5) -> DataFrame:
    """Curves of the ``k`` most frequent categories with their sizes, in one job.

    Sizes are sums over the per-time counts, so the persons are read once.
    """
    leaving = _leaving(df, time, event, [pattern])
    sizes = (
        leaving.filter(F.col(pattern).isNotNull())
        .groupBy(pattern)
        .agg(F.sum("leaving").alias("n"), F.sum("n_events").alias("events"))
        .orderBy(F.desc("n"), pattern)
        .limit(k)
    )
    kept = leaving.join(F.broadcast(sizes), pattern)  # k rows
    by = [pattern, "n", "events"]
    return _curve(_at_risk(kept, by), by, True).drop("greenwood")


def subgroup_logrank(
    df: DataFrame,
    time: str,
    event: str,
    group: str,
    first: object,
    second: object,
    stratum: str,
) -> DataFrame:
    """A log-rank test with p-value inside every stratum, in one job."""
    return logrank_pvalue(logrank_test(df, time, event, group, first, second, [stratum]))


def event_rate_ratio(df: DataFrame, exposed: Column, event: str, digits: int = 2) -> DataFrame:
    """Event percentage with and without exposure, and their ratio."""
    rates = df.agg(
        F.avg(F.when(~exposed, F.col(event))).alias("u"), F.avg(F.when(exposed, F.col(event))).alias("e")
    )
    return rates.select(
        F.round(F.col("u") * 100, digits).alias("rate_unexposed"),
        F.round(F.col("e") * 100, digits).alias("rate_exposed"),
        safe_ratio(F.col("e"), F.col("u"), digits=digits).alias("rate_ratio"),
    )
