"""Closed-form statistics as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published Chebyshev coefficients of the complementary error
# function (relative error about 1.2e-7 everywhere).
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)

# Two-sided 95 % point of the standard normal distribution.
Z_95 = 1.959963984540054


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0; null stays null."""
    t = F.lit(1.0) / (F.lit(1.0) + z * F.lit(0.5))
    series = reduce(lambda acc, c: F.lit(c) + t * acc, reversed(ERFC_COEFFICIENTS[:-1]), F.lit(ERFC_COEFFICIENTS[-1]))
    value = t * F.exp(-z * z + series)
    # least() skips nulls, so the cap must not see one.
    return F.when(value.isNotNull(), F.least(F.lit(1.0), value))


def chi2_upper_tail_df1(chi2: Column) -> Column:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return erfc(F.sqrt(chi2 / F.lit(2.0)))


def significance(p: Column) -> Column:
    """Verdict at the 0.001 and 0.05 levels; null for a null p-value."""
    return F.when(p < 0.001, F.lit("p<0.001")).when(p < 0.05, F.lit("p<0.05")).when(p >= 0.05, F.lit("p>=0.05"))
