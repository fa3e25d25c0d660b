"""Sets of months as bits: one bit a month, sixty months a number.

A block is five calendar years that begin with a multiple of five; the column
``months_1995`` holds the months from January 1995 (lowest bit) to December
1999.  Sets are united by ``bit_or``, so they collapse in every task, tables of
two periods or runs merge, and members are counted with ``bit_count``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEARS = 5
PREFIX = "months_"
MONTH = r"^[0-9]{4}(0[1-9]|1[0-2])$"


def month_number(text: Column) -> Column:
    """Months since January of year 0 of a ``yyyyMM`` text; null for anything else."""
    text = text.cast("string")
    number = F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 5, 2).cast("int") - 1
    return F.when(text.rlike(MONTH), number)


def month_span(df: DataFrame, month: str) -> tuple[str, str] | None:
    """First and last month of a column, from one pass over it; None without any."""
    held = F.when(F.col(month).cast("string").rlike(MONTH), F.col(month).cast("string"))
    row = df.agg(F.min(held).alias("first"), F.max(held).alias("last")).first()
    return (row["first"], row["last"]) if row["first"] else None


def blocks_of(span: tuple[str, str] | None) -> list[int]:
    """First years of the blocks that cover a span of months; one block at least."""
    first, last = (int(m[:4]) // YEARS * YEARS for m in span or ("200001", "200001"))
    return list(range(first, last + 1, YEARS))


def month_masks(month: Column, blocks: Sequence[int], when: Column | None = None) -> list[Column]:
    """Aggregates that collect the months of the rows for which ``when`` holds, a column for each block."""
    number = month_number(month)
    out = []
    for year in blocks:
        at = number - F.lit(year * 12)
        inside = at.between(0, YEARS * 12 - 1)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at)
        out.append(F.bit_or(F.when(inside if when is None else inside & when, bit).otherwise(F.lit(0).cast("long"))).alias(f"{PREFIX}{year}"))
    return out


def mask_columns(names: Iterable[str]) -> list[str]:
    """The columns that hold months."""
    return [n for n in names if n.startswith(PREFIX) and n[len(PREFIX) :].isdigit()]


def months_held(names: Iterable[str]) -> Column:
    """How many months are set in all blocks."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.coalesce(n, F.lit(0).cast("long"))).cast("long") for n in mask_columns(names)])


def merge_month_masks(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """One row per key from tables of several periods or runs; blocks that a table lacks are empty in it."""
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    names = sorted(mask_columns(united.columns))
    return united.groupBy(key).agg(*[F.bit_or(F.coalesce(n, F.lit(0).cast("long"))).alias(n) for n in names])
