"""Daily states of a table as change sets.

A day stores the rows that were inserted, changed or removed since the day
before, found by comparing digests by key.  A day's state is the last change
of every key up to it, from the newest full copy (:func:`store_base`) on, so a
day costs disk in proportion to its changes, not to the table.

Layout below a folder: ``changes/change_date=...`` with the table's columns,
the kind of change and the row's digest, and ``base/base_date=...`` with full
copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSERTED, CHANGED, REMOVED = "inserted", "changed", "removed"


def row_digest(columns: Sequence[str]):
    """SHA-256 of all values with their names; a null is told from any text."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return None


def _last_changes(spark: SparkSession, path: str, day: str, before: bool) -> DataFrame | None:
    """The last change of every key up to a day (or before it), removed keys included; None without any."""
    date = F.to_date(F.lit(day))
    changes, bases = _read(spark, f"{path}/changes"), _read(spark, f"{path}/base")
    parts, since = [], None
    if bases is not None:
        # A full copy holds the state at the end of its day, so it serves that day and later ones.
        known = bases.filter(F.col("base_date") < date if before else F.col("base_date") <= date)
        since = known.agg(F.max("base_date")).first()[0]
        if since is not None:
            parts.append(known.filter(F.col("base_date") == F.lit(since)).withColumnRenamed("base_date", "change_date"))
    if changes is not None:
        later = changes.filter(F.col("change_date") < date if before else F.col("change_date") <= date)
        parts.append(later if since is None else later.filter(F.col("change_date") > F.lit(since)))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _keys(stored: DataFrame) -> list[str]:
    return [c for c in stored.columns if c.startswith("__key_")]


def _newest(stored: DataFrame) -> DataFrame:
    """One row per key, its newest; in every task first, then by key."""
    keys = _keys(stored)
    rest = [c for c in stored.columns if c not in keys]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "change_date").alias("__row"))
    return newest.select(*keys, "__row.*")


def store_changes(df: DataFrame, path: str, day: str, key: Sequence[str]) -> None:
    """Store what ``df``, the state of a day, changes against the day before.

    ``key`` tells the rows of a state apart (a null is a value like any other);
    a key that occurs twice fails the job.  Running a day again replaces that
    day.  Days are stored in order: a day before stored ones would leave theirs
    against an older state.
    """
    spark = df.sparkSession
    columns = df.columns
    taken = [c for c in columns if c.startswith("__key_") or c in ("__kind", "__digest", "change_date", "base_date")]
    if taken:
        raise ValueError(f"columns {taken} are names of the store")
    names = [f"__key_{k}" for k in key]
    keyed = df.select(*[F.col(k).alias(n) for k, n in zip(key, names)], *columns, row_digest(columns).alias("__digest"))
    rows = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.struct(*columns, "__digest"), "__digest").alias("__new"))
    unique = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("key occurs twice: "), F.to_json(F.struct(*names))))).otherwise(F.col("__new"))
    new = rows.select(*names, unique.alias("__new"))
    former = _last_changes(spark, path, day, before=True)
    if former is None:
        changes = new.select(*names, "__new.*", F.lit(INSERTED).alias("__kind"))
    else:
        old = _newest(former).filter(F.col("__kind") != REMOVED)
        old = old.select(*[F.col(n).alias(f"_{n}") for n in names], F.struct(*columns, "__digest").alias("__old"))
        met = new.join(old, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names], "full_outer")
        fresh, gone = F.col("__old").isNull(), F.col("__new").isNull()
        kind = F.when(fresh, INSERTED).when(gone, REMOVED).when(F.col("__new.__digest") != F.col("__old.__digest"), CHANGED)
        row = F.coalesce("__new", "__old")
        here = [F.when(gone, F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in names]
        changes = met.select(*here, row.alias("__row"), kind.alias("__kind")).filter(F.col("__kind").isNotNull()).select(*names, "__row.*", "__kind")
    dated = changes.withColumn("change_date", F.to_date(F.lit(day)))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("change_date").parquet(f"{path}/changes")


def state_as_of(spark: SparkSession, path: str, day: str) -> DataFrame:
    """The table as it was at the end of a day: its latest stored state on or before it."""
    stored = _last_changes(spark, path, day, before=False)
    if stored is None:
        raise ValueError(f"no state is stored in {path}")
    hidden = [*_keys(stored), "__kind", "__digest", "change_date"]
    return _newest(stored).filter(F.col("__kind") != REMOVED).drop(*hidden)


def store_base(spark: SparkSession, path: str, day: str) -> None:
    """Store a day's state in full, so that later days are read from there on."""
    stored = _last_changes(spark, path, day, before=False)
    state = _newest(stored).filter(F.col("__kind") != REMOVED).drop("change_date").withColumn("base_date", F.to_date(F.lit(day)))
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("base_date").parquet(f"{path}/base")


def change_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows stored per day and kind of change."""
    return spark.read.parquet(f"{path}/changes").groupBy("change_date", F.col("__kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
