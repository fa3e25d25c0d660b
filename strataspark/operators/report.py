"""Reports that set results beside published values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.bands import TOTAL, ordinal
from strataspark.sources.codes import literal_table


def metric_report(
    df: DataFrame, metrics: Sequence[tuple[str, Column, str, str]], published: Mapping[str, str]
) -> DataFrame:
    """Long report ``(metric, reproduced, paper, note)`` from one aggregation.

    A metric is ``(name, aggregate, format, note)``; the format is ``,`` for a
    grouped count or a printf pattern for a number.
    """
    wide = df.agg(*[agg.alias(f"m{i}") for i, (_, agg, _, _) in enumerate(metrics)])

    def text(i: int, pattern: str) -> Column:
        value = F.col(f"m{i}")
        return F.format_number(value, 0) if pattern == "," else F.format_string(pattern, value.cast("double"))

    entries = [
        F.struct(
            F.lit(name).alias("metric"),
            text(i, pattern).alias("reproduced"),
            F.lit(published.get(name)).cast("string").alias("paper"),
            F.lit(note).alias("note"),
        )
        for i, (name, _, pattern, note) in enumerate(metrics)
    ]
    return wide.select(F.inline(F.array(*entries)))


def metric_values(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """Aggregates as rows ``(metric, value)``, from one aggregation."""
    wide = df.agg(*[agg.cast("double").alias(f"m{i}") for i, agg in enumerate(metrics.values())])
    entries = [
        F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("value")) for i, name in enumerate(metrics)
    ]
    return wide.select(F.inline(F.array(*entries)))


def compare_to_reference(
    result: DataFrame, label: str, value: str, published: Mapping[str, float], digits: int = 2
) -> DataFrame:
    """Reproduced and published value and their difference, for labels that have both."""
    rows = [(k, float(v)) for k, v in published.items()]
    paper = literal_table(result.sparkSession, rows, f"{label} string, published double")
    return result.join(paper, label).select(
        label,
        F.col(value).cast("double").alias("reproduced"),
        "published",
        F.round(F.col(value) - F.col("published"), digits).alias("difference"),
    )


def chart_series(
    table: DataFrame,
    label: str,
    columns: Sequence[str],
    labels: Sequence[str],
    published: DataFrame | None = None,
) -> DataFrame:
    """The columns of a result table in display order, without the total."""
    series = table.filter(F.col(label) != TOTAL).select(label, *columns)
    if published is not None:
        series = series.join(published, label)
    return series.withColumn("sort_key", ordinal(F.col(label), labels)).orderBy("sort_key", label)


def long_form(df: DataFrame, table: str, key: str) -> DataFrame:
    """Every value of a table as a row (table_name, row_key, column_name, number, text), for comparing stored tables.

    Numbers and booleans are numbers, everything else is text; ``key`` names
    the column that tells rows apart.  Rows are unfolded where they lie.
    """
    entries = []
    for field in df.schema:
        if field.name == key:
            continue
        numeric = field.dataType.simpleString() in ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean") or field.dataType.simpleString().startswith("decimal")
        value = F.col(field.name)
        entries.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                (value.cast("double") if numeric else F.lit(None).cast("double")).alias("number"),
                (F.lit(None).cast("string") if numeric else value.cast("string")).alias("text"),
            )
        )
    return df.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.inline(F.array(*entries)))
