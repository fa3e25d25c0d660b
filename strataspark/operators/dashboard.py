"""The datasets behind dashboard widgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.bands import bin_floor
from strataspark.functions.hashing import keyed_uniform


def _selected(field: str, chosen: Sequence) -> Column:
    return F.coalesce(F.col(field).isin(*chosen), F.lit(False))


def selection(selections: Mapping[str, Sequence], skip: str | None = None) -> Column:
    """Conjunction of the active filters; an empty selection admits everything."""
    tests = [_selected(f, chosen) for f, chosen in selections.items() if chosen and f != skip]
    return reduce(and_, tests) if tests else F.lit(True)


def apply_filters(df: DataFrame, selections: Mapping[str, Sequence]) -> DataFrame:
    """Rows that pass every active filter."""
    active = [F.col(f).isin(*chosen) for f, chosen in selections.items() if chosen]
    return df.filter(reduce(and_, active)) if active else df


def facet_counts(df: DataFrame, facets: Sequence[str], selections: Mapping[str, Sequence]) -> DataFrame:
    """Every value of every filter field, and how many rows would match it.

    A field's own selection does not count against its values.  Each row is
    unfolded into its fields, and partial aggregation leaves one row per value
    and task before the shuffle, however many combinations there are.
    """
    entries = [
        F.struct(
            F.lit(f).alias("facet"),
            F.col(f).cast("string").alias("value"),
            selection(selections, skip=f).cast("long").alias("matching"),
        )
        for f in facets
    ]
    return (
        df.select(F.inline(F.array(*entries)))
        .groupBy("facet", "value")
        .agg(F.sum("matching").alias("n_matching"))
    )


def bar(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(field).agg(F.count(F.lit(1)).alias("n"))


def line(df: DataFrame, day: str, name: str = "year") -> DataFrame:
    """Rows per calendar year."""
    return df.groupBy(F.year(day).alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(name)


def histogram(df: DataFrame, column: str, width: float, where: Column | None = None) -> DataFrame:
    """Rows per bin; null values form a bin of their own."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(bin_floor(F.col(column), width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histograms(df: DataFrame, widths: Mapping[str, float]) -> DataFrame:
    """Rows per bin of several columns as (measure, bin, n), from one pass."""
    entries = [F.struct(F.lit(c).alias("measure"), bin_floor(F.col(c), w).cast("double").alias("bin")) for c, w in widths.items()]
    return df.select(F.inline(F.array(*entries))).groupBy("measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def scatter(df: DataFrame, x: str, y: str, key: str | None = None, rate: float | None = None) -> DataFrame:
    """Raw pairs; with ``key`` and ``rate`` a repeatable share of them."""
    rows = df if rate is None else df.filter(keyed_uniform(F.col(key), "scatter") < rate)
    return rows.select(x, y)
