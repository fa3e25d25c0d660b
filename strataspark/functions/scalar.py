"""Scalar rules: ranges, ratios, flags, scores, calendar and key building."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_list(value: Column, codes: Sequence) -> Column:
    """Membership as literals, so the predicate can reach the file scan."""
    return value.isin(*codes)


def in_range(value: Column, low: float | None, high: float | None) -> Column:
    """Inclusive range test; a bound of ``None`` leaves that side open."""
    tests = []
    if low is not None:
        tests.append(value >= F.lit(low))
    if high is not None:
        tests.append(value <= F.lit(high))
    return reduce(and_, tests) if tests else F.lit(True)


def safe_ratio(
    numerator: Column, denominator: Column, scale: float = 1.0, digits: int | None = None
) -> Column:
    """``numerator / denominator * scale``, null for a zero or null denominator."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    if scale != 1.0:
        quotient = quotient * F.lit(float(scale))
    return quotient if digits is None else F.round(quotient, digits)


def age_at(on_date: Column, birth_date: Column) -> Column:
    """Whole years between two dates, counted in years of 365.25 days."""
    return F.floor(F.try_divide(F.datediff(on_date, birth_date), F.lit(365.25))).cast("int")


def service_month(day: Column) -> Column:
    """``yyyyMM`` text of a date, from its calendar fields alone (no time zone involved)."""
    return F.concat(F.lpad(F.year(day).cast("string"), 4, "0"), F.lpad(F.month(day).cast("string"), 2, "0"))


def month_index(day: Column) -> Column:
    """Calendar months since year 0; differences of it ignore the day of month."""
    return F.year(day) * 12 + F.month(day)


def padded_key(prefix: str, number: Column, width: int = 8) -> Column:
    """``prefix`` followed by the number, padded with zeros to ``width``."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def pseudonym(prefix: str, identifier: Column) -> Column:
    """The first 32 hex digits of SHA-256 over prefix and identifier."""
    return F.substring(F.sha2(F.concat(F.lit(prefix), identifier.cast("string")), 256), 1, 32)


def any_of(flags: Sequence[str]) -> Column:
    """1 when at least one of the 0/1 columns is 1; nulls count as 0."""
    filled = [F.coalesce(F.col(f), F.lit(0)) for f in flags]
    return (filled[0] if len(filled) == 1 else F.greatest(*filled)).cast("int")


def pattern_label(parts: Mapping[str, Column], joiner: str, only: str, none: str) -> Column:
    """One label per combination of conditions, in the order the parts are given.

    Several conditions are joined, a single one gets the ``only`` suffix and no
    condition gives ``none``.  A null condition counts as absent.
    """
    held = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in parts.items()]))
    return (
        F.when(F.size(held) == 0, F.lit(none))
        .when(F.size(held) == 1, F.concat(held[0], F.lit(only)))
        .otherwise(F.array_join(held, joiner))
    )


def additive_score(base: float, weights: Sequence[tuple[Column, float]]) -> Column:
    """Base plus the weight of every condition that holds."""
    terms = [F.when(test, F.lit(float(w))).otherwise(F.lit(0.0)) for test, w in weights]
    return reduce(add, terms, F.lit(float(base)))


def case_by_operand(operand: Column, arms: Mapping, default: Column) -> Column:
    """Value of the arm whose key equals the operand, cut to an integer."""
    chosen = [F.when(operand == F.lit(k), value) for k, value in arms.items()]
    return F.coalesce(*chosen, default).cast("int")


def array_pick(values: Sequence, index: Column) -> Column:
    """Element of a literal list at a computed 0-based index, null when out of range."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)
