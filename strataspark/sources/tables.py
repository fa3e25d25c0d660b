"""Reading, writing and inspecting tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataspark.sources.schemas import conform, schema_table

LAYERS = ("bronze", "silver", "gold")


def scan_table(spark: SparkSession, source: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table by catalog name, or a parquet folder when the source looks like a path."""
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    return df.select(*columns) if columns else df


def scan_derived(df: DataFrame, derived: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """All columns plus derived ones, over the rows that pass the predicate."""
    kept = df if where is None else df.filter(where)
    return kept.select("*", *[expr.alias(name) for name, expr in derived.items()])


# Ids that one row of a bounded source unfolds into.
SOURCE_STRETCH = 100_000


def row_source(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Consecutive ids ``start .. end-1`` as rows, generated in parallel."""
    return spark.range(start, end)


def row_source_to(bound: DataFrame, last: str) -> DataFrame:
    """Ids 0 to the value of ``last`` in the one row of ``bound``, dealt out in even stretches.

    The value is never brought to the driver; a null bound gives no rows.
    """
    span = F.lit(SOURCE_STRETCH)
    starts = bound.filter(F.col(last).isNotNull()).select(
        F.col(last).alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(last).cast("long"), span)).alias("start")
    )
    dealt = starts.repartition("start")
    return dealt.select(F.explode(F.sequence("start", F.least(F.col("start") + span - 1, F.col("last")))).alias("id"))


def namespaces(spark: SparkSession, root: str, layers: Sequence[str] = LAYERS, prefix: str = "") -> DataFrame:
    """Create one database per layer under a shared root; returns those present."""
    for layer in layers:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{prefix}{layer}` LOCATION '{root}/{prefix}{layer}'")
    wanted = [f"{prefix}{layer}" for layer in layers]
    return (
        spark.sql("SHOW DATABASES").toDF("namespace").filter(F.col("namespace").isin(*wanted))
    )


def write_overwrite(
    df: DataFrame,
    target: str,
    schema: StructType | None = None,
    partition_by: Sequence[str] = (),
    bucket_by: tuple[int, str] | None = None,
) -> int:
    """Replace a table (catalog name) or parquet folder (path); returns the rows written.

    The count is observed while the rows are written, so the table is not read
    back for it.  A partitioned write is rebalanced first: each value gets files
    of a sensible size, and a value that holds much of the data is split over
    tasks.  ``bucket_by`` (catalog tables only) stores rows hashed by a key,
    one file per bucket, which later joins and group-bys on that key use
    without a shuffle; it suits tables with about one row per key.
    """
    out = conform(df, schema) if schema is not None else df
    if partition_by:
        out = out.hint("rebalance", *partition_by)
    if bucket_by:
        out = out.repartition(bucket_by[0], bucket_by[1])
    seen = Observation()
    writer = out.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in target:
        if bucket_by:
            raise ValueError("bucketing needs a catalog table")
        writer.save(target)
    else:
        if bucket_by:
            count, key = bucket_by
            writer = writer.bucketBy(count, key).sortBy(key)
        writer.saveAsTable(target)
    return int(seen.get["rows"])


@dataclass(frozen=True)
class Expectation:
    """A test that the rows of a table are to pass; at most the share ``most`` of them may fail.

    A null test fails.
    """

    name: str
    test: Column
    most: float = 0.0


class ExpectationFailed(ValueError):
    """A table was not published; ``counts`` has the rows written and the failures of each expectation."""

    def __init__(self, target: str, broken: Sequence[str], counts: Mapping[str, int]):
        super().__init__(f"{target} keeps its former state; expectations that failed: {', '.join(broken)} ({dict(counts)})")
        self.broken, self.counts = list(broken), dict(counts)


def write_expected(
    df: DataFrame,
    target: str,
    expectations: Sequence[Expectation],
    schema: StructType | None = None,
    partition_by: Sequence[str] = (),
    least_rows: int = 0,
) -> dict[str, int]:
    """Replace a parquet folder if the rows meet what is expected of them; failures per expectation, and ``rows``.

    Failures are counted while the rows are written, by the tasks that write
    them: there is no second scan.  The rows go to a folder beside the target,
    which takes the target's place only when every expectation holds.
    Otherwise it is removed, the target stays as it was and readable, and
    :class:`ExpectationFailed` tells the counts.  A run that was cut off leaves
    the target alone as well.
    """
    if "/" not in target:
        raise ValueError("only folders are published by expectations")
    names = [e.name for e in expectations]
    if len({*names, "rows"}) != len(names) + 1:
        raise ValueError(f"expectations need names of their own: {names}")
    out = conform(df, schema) if schema is not None else df
    if partition_by:
        out = out.hint("rebalance", *partition_by)
    seen = Observation()
    failures = [F.count_if(~F.coalesce(e.test, F.lit(False))).alias(e.name) for e in expectations]
    staged = f"{target.rstrip('/')}__staged_{uuid.uuid4().hex}"
    writer = out.observe(seen, F.count(F.lit(1)).alias("rows"), *failures).write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(staged)
    counts = {name: int(n) for name, n in seen.get.items()}
    broken = [e.name for e in expectations if counts[e.name] > e.most * counts["rows"]]
    if counts["rows"] < least_rows:
        broken.append("rows")
    if broken:
        _remove(df.sparkSession, staged)
        raise ExpectationFailed(target, broken, counts)
    _put_in_place(df.sparkSession, staged, target)
    return counts


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _remove(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.delete(where, True)


def _put_in_place(spark: SparkSession, staged: str, target: str) -> None:
    """Let a finished folder take the place of another; the former one is put back if that fails."""
    new, files = _file_system(spark, staged)
    place, _ = _file_system(spark, target)
    aside, _ = _file_system(spark, f"{target.rstrip('/')}__former_{uuid.uuid4().hex}")
    had = files.exists(place)
    if had and not files.rename(place, aside):
        raise OSError(f"cannot move {target} aside")
    if not files.rename(new, place):
        if had:
            files.rename(aside, place)
        raise OSError(f"cannot put {staged} in the place of {target}")
    if had:
        files.delete(aside, True)
    spark.catalog.refreshByPath(target)


def create_table_as(spark: SparkSession, target: str, query: str | DataFrame, schema: StructType | None = None) -> DataFrame:
    """Create or replace a table from SQL text or a DataFrame and return it as a scan.

    The result reads the stored files, so later steps do not repeat the lineage.
    """
    df = spark.sql(query) if isinstance(query, str) else query
    write_overwrite(df, target, schema)
    return scan_table(spark, target)


def named_stage(df: DataFrame, name: str) -> DataFrame:
    """Register a stage for SQL users; nothing runs until it is queried."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def describe_table(df: DataFrame) -> DataFrame:
    """Schema of a table as rows; metadata only."""
    return schema_table(df.sparkSession, df.schema)


def describe_extended(spark: SparkSession, table: str) -> DataFrame:
    """Catalog details of a named table."""
    return spark.sql(f"DESCRIBE EXTENDED {table}")


def show_tables(spark: SparkSession, database: str) -> DataFrame:
    """Stored tables of a database, without the session's temporary views."""
    return spark.sql(f"SHOW TABLES IN `{database}`").filter(~F.col("isTemporary")).select("tableName").toDF("table_name")


def localize_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns for display; names that are absent are ignored."""
    return df.withColumnsRenamed(dict(names))


def small_collect(df: DataFrame, max_rows: int | None = None) -> pd.DataFrame:
    """A finished small table on the driver, whole; the caller knows that it is small.

    With ``max_rows`` a larger result is an error, never cut.
    """
    if max_rows is None:
        return df.toPandas()
    rows = df.limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"result has more than {max_rows} rows; aggregate it on the cluster first")
    return rows


def append_snapshot(df: DataFrame, path: str, snapshot_date: str) -> None:
    """Store the state of a table under its date; re-running a date replaces only that date."""
    (
        df.withColumn("snapshot_date", F.to_date(F.lit(snapshot_date)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def snapshot_as_of(spark: SparkSession, path: str, day: str) -> DataFrame:
    """The latest stored state on or before a day.

    Both filters are on the partition column: the inner scan reads no data
    column, the outer one is pruned to a single snapshot.
    """
    stored = spark.read.parquet(path)
    date = F.to_date(F.lit(day))
    latest = stored.filter(F.col("snapshot_date") <= date).agg(F.max("snapshot_date"))
    return stored.filter(F.col("snapshot_date") == latest.scalar())


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: name and number of rows, from column-free scans."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
