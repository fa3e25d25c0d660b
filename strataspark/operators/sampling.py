"""Repeatable samples and row shaping on real tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataspark.functions.hashing import keyed_uniform

# Rows of a key are dealt by the leading digits of their draw into this many parts.
PARTS = 4096


def hash_sample(df: DataFrame, key: Column, salt: str, rate: float | Column) -> DataFrame:
    """Rows whose keyed draw lies below the rate, which may differ by row."""
    bound = rate if isinstance(rate, Column) else F.lit(float(rate))
    return df.filter(keyed_uniform(key, salt) < bound)


def draw_counts(drawn: DataFrame, group: str = "__k", part: str = "__part", limit: str = "__n") -> DataFrame:
    """Per group and leading digits of the draw: how many rows there are, and how many lie in lower parts.

    Counts are summed in every task first; the window that adds them up sees
    at most ``PARTS`` counts of a group, never its rows.  Parts that begin
    beyond the rank asked for are gone.
    """
    counted = drawn.groupBy(group, part).agg(F.count(F.lit(1)).alias("__held"), F.max(limit).alias("__most"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__before", F.coalesce(F.sum("__held").over(before), F.lit(0)))
    return placed.filter(F.col("__before") < F.col("__most")).select(group, part, "__before")


def pick_n_per_key(df: DataFrame, key: str, row_id: str, salt: str, n: int | Column) -> DataFrame:
    """``n`` repeatable random rows per key with their rank ``pick``, all rows of keys that have fewer.

    ``n`` is a number of any size or a column that is constant within a key; a
    null or negative ``n`` picks nothing.  A null key is a key of its own.

    Ranks are found by counting: draws are counted per key and leading digits,
    running counts tell in which part rank ``n`` falls and how many rows lie
    below each part, rows of higher parts are dropped, and what is left is
    ranked part by part.  Draws are even, so a key with ``r`` rows has about
    ``r / PARTS`` of them in a part: no task ranks a whole hot key, whatever
    ``n``.
    """
    draw = keyed_uniform(F.col(row_id), salt)
    drawn = df.withColumns(
        {
            # A struct of a null equals another one, so null keys meet in the join.
            "__k": F.struct(F.col(key)),
            "__u": draw,
            "__part": F.floor(draw * PARTS).cast("int"),
            "__n": (n if isinstance(n, Column) else F.lit(n)).cast("long"),
        }
    )
    kept = drawn.join(draw_counts(drawn), ["__k", "__part"])
    place = F.row_number().over(Window.partitionBy("__k", "__part").orderBy("__u", row_id))
    ranked = kept.withColumn("pick", F.col("__before") + place).filter(F.col("pick") <= F.col("__n"))
    return ranked.withColumn("pick", F.col("pick").cast("int")).select(*df.columns, "pick")


def explode_n(df: DataFrame, n: Column, ordinal: str = "seq") -> DataFrame:
    """Each row ``n`` times with its ordinal; rows with ``n`` below 1 or null give none."""
    return df.withColumn(ordinal, F.explode(F.when(n >= 1, F.sequence(F.lit(1), n.cast("int")))))
