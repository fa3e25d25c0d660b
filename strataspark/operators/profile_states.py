"""Profiles that merge: states per part of a table, stored once and united when a profile is asked for.

A part is whatever arrives together, a day say.  Its state is one row per
column: counts, range, mean and sum of squared deviations, which unite
exactly, and two sketches of bounded size, for distinct values and for
quantiles.  The profile of a grown table reads states only; the rows of former
parts are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Relative error of distinct counts about 1.04 / sqrt(2 ** LG_K), three times that in rare cases.
LG_K = 14
# Rank error of quantiles, as a share of the rows, below 0.6 % with near certainty.
KLL_K = 400
NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def column_states(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its state, from one pass over the rows and one aggregation.

    Text has no range, mean or quantiles.  Distinct values of numbers are those
    of their doubles.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    aggregates, entries = [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(columns):
        numeric = kinds[c] in NUMERIC
        value = F.col(c).cast("double") if numeric else F.col(c).cast("string")
        aggregates += [F.count(value).alias(f"n{i}"), F.hll_sketch_agg(value.cast("string"), LG_K).alias(f"d{i}")]
        if numeric:
            aggregates += [
                F.min(value).alias(f"a{i}"),
                F.max(value).alias(f"b{i}"),
                F.avg(value).alias(f"m{i}"),
                (F.var_pop(value) * F.count(value)).alias(f"s{i}"),
                F.kll_sketch_agg_double(value, KLL_K).alias(f"q{i}"),
            ]
        none = F.lit(None).cast("double")
        numbers = {n: F.col(f"{k}{i}") if numeric else none for n, k in (("least", "a"), ("most", "b"), ("mean", "m"), ("squares", "s"))}
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("rows"),
                F.col(f"n{i}").alias("n"),
                *[v.alias(k) for k, v in numbers.items()],
                F.col(f"d{i}").alias("distinct_sketch"),
                (F.col(f"q{i}") if numeric else F.lit(None).cast("binary")).alias("quantile_sketch"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def store_states(df: DataFrame, path: str, part: str, columns: Sequence[str]) -> None:
    """Store the states of a part; running a part again replaces it."""
    states = column_states(df, columns).withColumn("part", F.lit(part))
    states.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def merged_states(states: DataFrame) -> DataFrame:
    """One state per column from states of disjoint parts; again a state that merges."""
    whole = Window.partitionBy("column_name")  # as many rows as there are parts
    mean = F.sum(F.col("mean") * F.col("n")).over(whole) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))).over(whole)
    # Deviations of the parts' means from the common mean: no difference of large sums.
    near = states.withColumn("_mean", mean).withColumn("_moved", F.col("squares") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2)
    return near.groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.max("_mean").alias("mean"),
        F.sum("_moved").alias("squares"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def profile_of(states: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Rows, values, nulls, range, mean, deviation (exact), distinct values and quantiles (estimated) per column.

    Numbers that a column of text or without values does not have are null.
    """
    some = F.col("most").isNotNull()

    def at(q: float):
        return F.when(some, F.kll_sketch_get_quantile_double(F.col("quantile_sketch"), F.lit(q))).alias(f"p{round(q * 100):02d}")

    return states.select(
        "column_name",
        "rows",
        "n",
        (F.col("rows") - F.col("n")).alias("nulls"),
        F.try_divide((F.col("rows") - F.col("n")) * 100.0, F.col("rows")).alias("null_pct"),
        F.col("least").alias("min"),
        F.col("most").alias("max"),
        "mean",
        F.when(F.col("n") > 1, F.sqrt(F.try_divide(F.col("squares"), F.col("n") - 1))).alias("std"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"),
        *[at(q) for q in quantiles],
    )


def stored_profile(spark: SparkSession, path: str, parts: Sequence[str] | None = None) -> DataFrame:
    """The profile of all stored parts, or of some; no row of the table is read."""
    states = spark.read.option("recursiveFileLookup", "false").parquet(path)
    if parts is not None:
        states = states.filter(F.col("part").cast("string").isin(*parts))
    return profile_of(merged_states(states))
