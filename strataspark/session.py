"""Session defaults and the one shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Shuffles start with many small partitions (``initial_partitions``) that the
# runtime merges up to the advisory size; without ``parallelismFirst=false`` it
# would ignore that size.  Skewed join partitions are split even where that
# costs one more exchange.
INITIAL_PARTITIONS = 8_000
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(
    app_name: str = "strataspark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the defaults above; ``master`` is for tests and benches only.

    Without ``shuffle_partitions`` (a small number for a local run) shuffles
    start with ``INITIAL_PARTITIONS``: at 128 MB each, enough for 1 TB.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
        conf["spark.sql.adaptive.coalescePartitions.parallelismFirst"] = "true"
    else:
        conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(INITIAL_PARTITIONS)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application under the shared location the session names.

    ``spark.checkpoint.dir`` is used as given.  Only a local master without
    that setting (a unit test) falls back to a temporary folder; on a cluster
    a missing setting is an error, since executors share no local disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/strataspark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder of this application."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Drop this application's scratch databases and tables, then its folder; results still to be read from it are lost."""
    root = scratch_root(spark)
    inside = root.split(":", 1)[-1].lstrip("/") + "/"
    for database in spark.catalog.listDatabases():
        if inside in database.locationUri:
            spark.sql(f"DROP DATABASE IF EXISTS `{database.name}` CASCADE")
    drop_folder(spark, root)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
