"""A stored cube for filters: counts and sums over the combinations of filter fields.

Cells are counted once over all fields, and every narrower combination is
summed from these cells, not from rows.  Each combination is a folder of its
own, so a question reads only the cells of the fields it names; combinations
of more than ``widest`` fields are not stored and are left to a scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators.dashboard import apply_filters, facet_counts, selection

SET = "fields"


def set_name(fields: Sequence[str]) -> str:
    """The folder of a combination, whatever the order of its fields."""
    return "+".join(sorted(fields)) or "all"


def store_cube(
    df: DataFrame, path: str, fields: Sequence[str], measures: Mapping[str, Column] | None = None, widest: int | None = None
) -> None:
    """Store ``n`` and the sums of ``measures`` for every combination of up to ``widest`` fields (all of them by default).

    One pass over the rows; a null value is a value.  Replaces a former cube.
    """
    widest = len(fields) if widest is None else widest
    sums = measures or {}
    cells = df.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(m) for m, v in sums.items()])
    sets = [list(c) for k in range(min(widest, len(fields)) + 1) for c in combinations(fields, k)]
    # grouping_id has a bit for each field that a set leaves out, the first field highest.
    names = {}
    for s in sets:
        left_out = sum(1 << (len(fields) - 1 - i) for i, f in enumerate(fields) if f not in s)
        names[left_out] = set_name(s)
    label = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in (int(pair[0]), pair[1])]), F.grouping_id().cast("int"))
    summed = cells.groupingSets([[F.col(f) for f in s] for s in sets], *fields).agg(
        label.alias(SET), F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in sums]
    )
    summed.write.mode("overwrite").partitionBy(SET).parquet(path)


def cells_of(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame | None:
    """The cells of exactly these fields; None if their combination is not stored."""
    try:
        return spark.read.parquet(f"{path}/{SET}={set_name(fields)}")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def _asked(field: str | None, selections: Mapping[str, Sequence]) -> list[str]:
    active = [f for f, chosen in selections.items() if chosen and f != field]
    return [*([field] if field else []), *active]


def cube_facets(spark: SparkSession, path: str, facets: Sequence[str], selections: Mapping[str, Sequence], base: DataFrame) -> DataFrame:
    """:func:`facet_counts` of the cube's rows; ``base``, the rows, is scanned only for combinations the cube lacks.

    Each facet reads the cells of its field and of the other fields with a filter.
    """
    parts, left = [], []
    for f in facets:
        cells = cells_of(spark, path, _asked(f, selections))
        if cells is None:
            left.append(f)
            continue
        matching = F.when(selection(selections, skip=f), F.col("n")).otherwise(F.lit(0).cast("long"))
        counted = cells.groupBy(F.col(f).cast("string").alias("value")).agg(F.sum(matching).alias("n_matching"))
        parts.append(counted.select(F.lit(f).alias("facet"), "value", "n_matching"))
    if left:
        parts.append(facet_counts(base, left, selections).select("facet", "value", "n_matching"))
    return reduce(DataFrame.unionByName, parts)


def cube_bar(
    spark: SparkSession, path: str, field: str, selections: Mapping[str, Sequence], base: DataFrame, measures: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows (and sums of ``measures``) per value of a field among those that pass every filter."""
    cells = cells_of(spark, path, list(dict.fromkeys(_asked(field, selections))))
    names = list(measures or {})
    if cells is not None:
        return apply_filters(cells, selections).groupBy(field).agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in names])
    return apply_filters(base, selections).groupBy(field).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(m) for m, v in (measures or {}).items()])
