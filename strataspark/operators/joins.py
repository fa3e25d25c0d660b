"""Joins in the shapes the cohort work needs; all are equi-joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_facts(
    facts: DataFrame, claims: DataFrame, key: str, salts: int | None = None, spread_by: Sequence[str] = ()
) -> DataFrame:
    """Inner join of facts with the claims they belong to.

    The planner picks the strategy by size, and adaptive execution splits a
    partition that one hot claim makes too large.  ``salts`` does the split in
    the plan itself, for sessions without adaptive execution: every claim is
    repeated once per salt and each fact meets one of the copies.  The salt is a
    hash of the ``spread_by`` columns (a line number, say), so a task that is
    run again sends every row to the same place as before.
    """
    if salts is None:
        return facts.join(claims, key)
    if not spread_by:
        raise ValueError("name the columns that tell the facts of one claim apart")
    spread = facts.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts).cast("long")))
    copies = claims.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, [key, "__salt"]).drop("__salt")


# A key is hot from this share of all facts on.
HOT_SHARE = 0.001
# Items that a sketch tracks.  Every key of more than about 3.5 / 8192 of the
# rows, less than half of HOT_SHARE, is certain to be among them.
TRACKED = 10_000


def key_sketch(facts: DataFrame, key: str, tracked: int = TRACKED) -> DataFrame:
    """One row: the sketch of frequent keys and the number of rows, null keys left out.

    Sketches of parts or of several days are united by :func:`merge_key_sketches`.
    """
    known = facts.filter(F.col(key).isNotNull())
    return known.agg(
        F.call_function("approx_top_k_accumulate", F.col(key), F.lit(tracked)).alias("sketch"), F.count(F.lit(1)).alias("n")
    )


def merge_key_sketches(sketches: Sequence[DataFrame], tracked: int = TRACKED) -> DataFrame:
    """One sketch for all the rows that the given ones have seen."""
    united = reduce(DataFrame.unionByName, sketches)
    return united.agg(F.call_function("approx_top_k_combine", F.col("sketch"), F.lit(tracked)).alias("sketch"), F.sum("n").alias("n"))


def hot_keys(sketch: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys with at least about ``share`` of all rows, and in how many ``pieces`` each is to be cut.

    A piece holds about ``share`` of all rows.  There are no more than
    ``2 / share`` such keys, whatever the table: a local relation of proven size.
    """
    most = int(2 / share)
    spark = sketch.sparkSession
    counted = sketch.select("n", F.explode(F.call_function("approx_top_k_estimate", F.col("sketch"), F.lit(most))).alias("e"))
    rows = counted.filter(F.col("e.count") >= F.col("n") * share / 2).select(
        F.col("e.item").alias(key), F.ceil(F.col("e.count") / (F.col("n") * share)).cast("int").alias("pieces")
    )
    return spark.createDataFrame(rows.collect(), rows.schema)


def join_hot(
    facts: DataFrame,
    claims: DataFrame,
    key: str,
    spread_by: Sequence[str],
    hot: DataFrame | None = None,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Inner join of facts with the claims they belong to, in which only hot keys are salted.

    A sketch finds the hot keys and how hot they are (``hot``, when it is known
    already).  Facts of a hot key are dealt to its pieces by a hash of the
    ``spread_by`` columns, so a task that is run again sends every row to the
    same place; its claims are repeated once per piece.  All other keys, the
    bulk of the claims, are joined as they are.  No task gets much more than
    ``share`` of the facts beside its even part.
    """
    if not spread_by:
        raise ValueError("name the columns that tell the facts of one claim apart")
    hot = hot_keys(key_sketch(facts, key), key, share) if hot is None else hot
    few = F.broadcast(hot.select(F.col(key).alias("__hot"), "pieces"))  # 2 / share rows at most
    pieces = F.coalesce(F.col("pieces"), F.lit(1))
    known = facts.join(few, F.col(key) == F.col("__hot"), "left")
    salt = F.pmod(F.xxhash64(*spread_by), pieces.cast("long")).cast("int")
    dealt = known.withColumn("__salt", F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(salt)).drop("__hot", "pieces")
    copies = claims.join(few, F.col(key) == F.col("__hot"), "left")
    copies = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("__hot", "pieces")
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def enrich(master: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Left join of one-row-per-key tables to a master."""
    for table in tables:
        master = master.join(table, key, "left")
    return master


def semi(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``; the keys are made distinct before they are shuffled."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def month_list(first: str, last: str) -> list[str]:
    """``yyyyMM`` texts from the first to the last month of a study period."""
    start, end = (int(m[:4]) * 12 + int(m[4:]) - 1 for m in (first, last))
    return [f"{i // 12:04d}{i % 12 + 1:02d}" for i in range(start, end + 1)]


def _month_array(months: Sequence[str]) -> Column:
    return F.array(*[F.lit(m) for m in months])


def entity_panel(entities: DataFrame, first: str, last: str, month: str = "service_month") -> DataFrame:
    """Every entity in every month of a study period.

    Months come from a constant array exploded beside each row, so there is no
    join at all and the row count is exactly entities x months.
    """
    return entities.withColumn(month, F.explode(_month_array(month_list(first, last))))


def activity_panel(
    entities: DataFrame,
    activity: DataFrame,
    key: str,
    first: str,
    last: str,
    month: str = "service_month",
    measure: str = "n",
) -> DataFrame:
    """A panel of entity and month with the activity of each month, zero where there was none.

    Activity is counted per entity and month, and the months an entity has are
    gathered into one map, which is unfolded beside the list of months after
    the join.  So entities are shuffled once each and not once per month, no
    expression grows with the length of the period, and a map holds the months
    with activity only.
    """
    months = month_list(first, last)
    held = activity.filter(F.col(month).between(first, last)).groupBy(key, month).agg(F.count(F.lit(1)).alias("__n"))
    maps = held.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(month, "__n"))).alias("__months"))
    panel = entities.join(maps, key, "left").withColumn(month, F.explode(_month_array(months)))
    count = F.coalesce(F.element_at("__months", F.col(month)), F.lit(0).cast("long"))
    return panel.select(*entities.columns, month, count.alias(measure))


def lookup_left(df: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep every row, add the lookup's columns; null keys never match."""
    return df.join(lookup, list(on), "left")


def lookup_inner(df: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that have a published counterpart."""
    return df.join(lookup, list(on))
