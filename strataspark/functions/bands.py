"""Interval labels, ordinal positions and histogram bins as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

TOTAL = "Total"


def _literals(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _edges_passed(tests: Sequence[Column]) -> Column:
    """How many of the tests hold; null when the tested value is null."""
    return reduce(add, [t.cast("int") for t in tests])


def _pick(labels: Sequence[str], position: Column) -> Column:
    """The label at a 1-based position, null for position 0 or past the end."""
    return F.get(_literals(labels), position - 1)


def band_left_closed(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``[edge, next edge)``; null outside the edges and for null.

    The number of edges at or below the value is the interval's position, so one
    sum of comparisons and one array lookup replace a chain of branches.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("bands need one more edge than labels")
    return _pick(labels, _edges_passed([value >= F.lit(e) for e in edges]))


def band_right_closed(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edge, next edge]``; null outside the edges and for null."""
    if len(edges) != len(labels) + 1:
        raise ValueError("bands need one more edge than labels")
    return _pick(labels, _edges_passed([value > F.lit(e) for e in edges]))


def band_between(
    value: Column,
    ranges: Sequence[tuple[str, int, int]],
    otherwise: str,
    null_label: str | None = None,
) -> Column:
    """Label of the first closed range holding the value, else ``otherwise``.

    A null value gets ``null_label`` (null by default) instead of falling into
    the last band.
    """
    hits = [F.when(value.between(lo, hi), F.lit(label)) for label, lo, hi in ranges]
    return F.when(value.isNull(), F.lit(null_label)).otherwise(F.coalesce(*hits, F.lit(otherwise)))


def decode(code: Column, names: Mapping[str, str], default: str) -> Column:
    """Code to name through a literal map; unknown and null codes give ``default``."""
    entries = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), code), F.lit(default))


def ordinal(label: Column, labels: Sequence[str], total: str = TOTAL) -> Column:
    """Position of a label in its list, the total label last, unknown or null after it."""
    order = [*labels, total]
    found = F.array_position(_literals(order), label)
    return F.coalesce(F.nullif(found, F.lit(0).cast("long")), F.lit(len(order) + 1).cast("long")).cast("int")


def bin_floor(value: Column, width: float) -> Column:
    """Lower edge of the bin of the given width; null stays null."""
    return F.floor(value / F.lit(float(width))).cast("double") * F.lit(float(width))
