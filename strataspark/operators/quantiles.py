"""Exact quantiles without a sort of the whole column and without one big task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SKETCH_ACCURACY = 10_000
BUCKETS = 1_000


def _quantile_map(df: DataFrame, columns: Sequence[str], q: float) -> Column:
    """Scalar subquery: map of column position to the exact quantile of that column.

    All columns share two passes over the rows.  The first sketches, per
    column, two values that surround the wanted rank.  The second counts what
    lies below them as one group and keeps the distinct values in between with
    their counts, well under a thousandth of the rows.  Those counts are summed
    over buckets to find the bucket of the rank, and only that bucket's values
    are put in order.  A value that repeats very often is one counted row
    throughout.

    The bracket cannot miss.  A column of at most ``SKETCH_ACCURACY`` values is
    its own bracket.  Of more values, n, a probe is off by at most
    n / SKETCH_ACCURACY ranks, which is one at least, and is asked four times
    that away from the wanted rank; the three that are left exceed what
    rounding ranks can take.
    """
    values = [F.col(c).cast("double") for c in columns]
    slack = 4.0 / SKETCH_ACCURACY
    probes = [max(0.0, q - slack), min(1.0, q + slack)]
    sketch = df.agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
        *[F.percentile_approx(v, probes, SKETCH_ACCURACY).alias(f"p{i}") for i, v in enumerate(values)],
        *[F.array(F.min(v), F.max(v)).alias(f"r{i}") for i, v in enumerate(values)],
    )

    def probed(i: int, k: int) -> Column:
        few = F.col(f"n{i}") <= SKETCH_ACCURACY
        return F.when(few, F.get(f"r{i}", F.lit(k))).otherwise(F.get(f"p{i}", F.lit(k)))

    bounds = sketch.select(
        F.array(
            *[
                F.struct(F.col(f"n{i}").alias("n"), probed(i, 0).alias("low"), probed(i, 1).alias("high"))
                for i in range(len(columns))
            ]
        )
    ).scalar()
    # The bounds are attached as a column, once before and once after the counting.
    rows = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)], bounds.alias("bounds"))
    bound = [F.get("bounds", F.lit(i)) for i in range(len(columns))]
    # Of each row, the columns whose value is not above the bracket; null stands for "below it".
    kept = [
        F.when(
            F.col(f"v{i}") <= b["high"],
            F.struct(F.lit(i).alias("c"), F.when(F.col(f"v{i}") >= b["low"], F.col(f"v{i}")).alias("v")),
        )
        for i, b in enumerate(bound)
    ]
    counted = rows.select(F.inline(F.array_compact(F.array(*kept)))).groupBy("c", "v").agg(F.count(F.lit(1)).alias("size"))
    here = F.col("here")
    place = F.floor(F.try_divide(F.col("v") - here["low"], here["high"] - here["low"]) * BUCKETS)
    rank = (here["n"] - 1) * F.lit(float(q))
    # Bucket -1 holds the one row that stands for everything below the bracket.
    bucketed = counted.withColumn("here", F.get(bounds, F.col("c"))).select(
        "c",
        "v",
        "size",
        F.when(F.col("v").isNotNull(), F.coalesce(place, F.lit(0).cast("long"))).otherwise(F.lit(-1).cast("long")).alias("bucket"),
        F.floor(rank).alias("lower"),
        F.ceil(rank).alias("upper"),
        (rank - F.floor(rank)).alias("part"),
    )
    # BUCKETS + 2 rows per column at most reach the first window.
    across = Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    within = Window.partitionBy("c", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    totals = bucketed.groupBy("c", "bucket", "lower", "upper").agg(F.sum("size").alias("rows"))
    wanted = (
        totals.withColumn("upto", F.sum("rows").over(across))
        .withColumn("before", F.col("upto") - F.col("rows"))
        .filter((F.col("before") <= F.col("upper")) & (F.col("upto") > F.col("lower")))
        .select("c", "bucket", "before")
    )
    ranked = bucketed.join(F.broadcast(wanted), ["c", "bucket"]).withColumn(  # two rows per column at most
        "upto", F.col("before") + F.sum("size").over(within)
    )
    picked = ranked.groupBy("c", "part").agg(
        F.min(F.when(F.col("upto") > F.col("lower"), F.col("v"))).alias("a"),
        F.min(F.when(F.col("upto") > F.col("upper"), F.col("v"))).alias("b"),
    )
    found = F.col("a").isNotNull() & F.col("b").isNotNull()
    missed = F.raise_error(F.lit("quantile bracket missed the rank")).cast("double")
    between = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    value = F.when(found, between).otherwise(missed).alias("value")
    # One entry per column.
    return picked.select("c", value).agg(F.map_from_entries(F.collect_list(F.struct("c", "value")))).scalar()


def exact_quantiles(df: DataFrame, columns: Sequence[str], q: float = 0.5, name: str = "value") -> DataFrame:
    """One row per column: its name and exact quantile, interpolated between neighbours.

    Null for a column without values.
    """
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.try_element_at("found", F.lit(i)).alias(name))
        for i, c in enumerate(columns)
    ]
    found = df.sparkSession.range(1).select(_quantile_map(df, columns, q).alias("found"))
    return found.select(F.inline(F.array(*rows)))


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: its name and exact median."""
    return exact_quantiles(df, columns, 0.5, "median")


def impute_median(df: DataFrame, columns: Sequence[str], suffix: str = "_imputed") -> DataFrame:
    """Add ``<column>_imputed`` where nulls are replaced by the column's exact median.

    The medians arrive as one scalar subquery, so the rows themselves are
    neither shuffled nor joined.
    """
    filled = {
        c + suffix: F.coalesce(F.col(c).cast("double"), F.try_element_at("__medians", F.lit(i)))
        for i, c in enumerate(columns)
    }
    return df.withColumn("__medians", _quantile_map(df, columns, 0.5)).withColumns(filled).drop("__medians")
