import pytest
from pyspark.sql import functions as F

from strataspark.session import scratch_path
from strataspark.sources import codes, schemas, tables


def test_overwrite_is_idempotent_and_counts(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    assert tables.write_overwrite(df, path, partition_by=["p"]) == 10
    assert tables.write_overwrite(df.filter("id < 4"), path, partition_by=["p"]) == 4
    assert tables.scan_table(spark, path).count() == 4


def test_bucketed_tables_join_without_a_shuffle(spark):
    from conftest import plan_of

    root = scratch_path(spark, "buckets")
    database = "b" + root.rsplit("-", 1)[1][:10]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{root}'")
    left = spark.range(1000).withColumn("a", F.col("id") * 2)
    right = spark.range(1000).withColumn("b", F.col("id") * 3)
    tables.write_overwrite(left, f"{database}.l", bucket_by=(4, "id"))
    tables.write_overwrite(right, f"{database}.r", bucket_by=(4, "id"))
    former = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = spark.table(f"{database}.l").join(spark.table(f"{database}.r"), "id").groupBy("id").agg(F.sum("b"))
        assert "Exchange" not in plan_of(joined)
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", former)
        spark.sql(f"DROP DATABASE {database} CASCADE")


def test_conform_orders_casts_and_refuses(spark):
    df = spark.createDataFrame([(1, 2.0, "def_3", "x")], "n_patients int, prevalence_pct double, definition string, extra string")
    out = schemas.conform(df, schemas.SILVER["definitions_summary"])
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [
        ("definition", "string"), ("n_patients", "bigint"), ("prevalence_pct", "double"),
    ]
    assert out.schema["definition"].metadata["comment"] == "cohort definition"
    with pytest.raises(ValueError, match="prevalence_pct"):
        schemas.conform(df.drop("prevalence_pct"), schemas.SILVER["definitions_summary"])


def test_row_source_to(spark):
    bound = spark.createDataFrame([(250_000,)], "last long")
    ids = tables.row_source_to(bound, "last")
    assert ids.count() == ids.distinct().count() == 250_001 and ids.agg({"id": "max"}).first()[0] == 250_000
    assert tables.row_source_to(spark.createDataFrame([(None,)], "last long"), "last").count() == 0
    assert tables.row_source_to(spark.createDataFrame([(0,)], "last long"), "last").count() == 1


def test_small_collect_refuses_instead_of_cutting(spark):
    assert len(tables.small_collect(spark.range(20_000))) == 20_000
    assert len(tables.small_collect(spark.range(5), 5)) == 5
    with pytest.raises(ValueError, match="more than 5"):
        tables.small_collect(spark.range(6), 5)


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    tables.append_snapshot(spark.range(3), path, "2024-01-01")
    tables.append_snapshot(spark.range(5), path, "2024-02-01")
    tables.append_snapshot(spark.range(4), path, "2024-02-01")  # a repeated day replaces itself
    assert tables.snapshot_as_of(spark, path, "2024-01-31").count() == 3
    assert tables.snapshot_as_of(spark, path, "2024-02-01").count() == 4
    assert tables.snapshot_as_of(spark, path, "2023-12-31").count() == 0


def test_localize_ignores_absent_names(spark):
    df = spark.createDataFrame([("a", 1)], "common_key string, x int")
    assert tables.localize_columns(df, codes.JAPANESE_COLUMNS).columns == ["共通キー", "x"]


def test_code_lists_are_disjoint_from_exclusions():
    assert len(codes.DIAGNOSIS_CODES) == 16
    assert not set(codes.DIAGNOSIS_CODES) & set(codes.EXCLUDED_DIAGNOSIS_CODES)
    assert len(codes.flatten(codes.DRUG_GROUPS)) == 17


def test_describe_and_show(spark):
    root = scratch_path(spark, "desc")
    database = "d" + root.rsplit("-", 1)[1][:10]
    assert [r[0] for r in tables.namespaces(spark, root, ["x"], database).collect()] == [f"{database}x"]
    tables.create_table_as(spark, f"{database}x.t", "SELECT 1 AS a, 'b' AS c")
    assert [r[0] for r in tables.show_tables(spark, f"{database}x").collect()] == ["t"]
    described = {r["col_name"] for r in tables.describe_extended(spark, f"{database}x.t").collect()}
    assert {"a", "c", "Provider"} <= described
    assert [(r["column_name"], r["data_type"]) for r in tables.describe_table(spark.table(f"{database}x.t")).collect()] == [
        ("a", "int"), ("c", "string"),
    ]
    spark.sql(f"DROP DATABASE {database}x CASCADE")


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        scratch_path(Session(), "x")
