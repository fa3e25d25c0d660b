"""Repeatable pseudo-random choices: the same key and salt always give the same draw.

Draws depend on nothing but the row's key, so they survive task retries,
repartitioning and re-runs, and filters on them may be pushed or reordered.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 over key and salt."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("|" + salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def weighted_bucket(draw: Column, weights: Mapping[str, float]) -> Column:
    """Label drawn with the given weights (normalised here) from one uniform draw."""
    total = float(sum(weights.values()))
    labels = list(weights)
    bounds = [b / total for b in accumulate(weights.values())][:-1]
    passed = F.lit(0)
    for bound in bounds:
        passed = passed + (draw >= F.lit(bound)).cast("int")
    return F.get(F.array(*[F.lit(x) for x in labels]), passed)


def mask_at_rate(value: Column, key: Column, salt: str, rate: float) -> Column:
    """The value, made null for a keyed fraction of the rows."""
    return F.when(keyed_uniform(key, salt) >= F.lit(float(rate)), value)


def assign_by_rule(
    rule: Column, label: str, key: Column, salt: str, otherwise: Mapping[str, float]
) -> Column:
    """``label`` where the rule holds, else a keyed weighted choice."""
    return F.when(rule, F.lit(label)).otherwise(weighted_bucket(keyed_uniform(key, salt), otherwise))
