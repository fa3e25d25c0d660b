import re

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from strataspark.operators import cube
from strataspark.operators import dashboard as da
from strataspark.session import scratch_path

FIELDS = ["a", "b", "c"]
MEASURES = {"total": "v"}


@pytest.fixture(scope="module")
def base(spark):
    return spark.range(3000).select(
        (F.col("id") % 3).cast("string").alias("a"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 5).cast("int").alias("b"),
        F.concat(F.lit("c"), F.floor(F.col("id") / 700).cast("string")).alias("c"),
        F.col("id").alias("v"),
    )


@pytest.fixture(scope="module", params=[None, 2, 0])
def stored(spark, base, request):
    path = scratch_path(spark, "cube")
    cube.store_cube(base, path, FIELDS, {"total": F.col("v")}, request.param)
    return path, request.param


SELECTIONS = [{}, {"a": ["0", "2"]}, {"a": ["1"], "b": [1, 4]}, {"a": ["1"], "b": [2], "c": ["c0", "c3"]}, {"a": [], "c": ["none"]}]


@pytest.mark.parametrize("chosen", SELECTIONS)
def test_facets_and_bars_equal_the_scan(spark, base, stored, rows, chosen):
    path, _ = stored
    columns = ("facet", "value", "n_matching")
    assert rows(cube.cube_facets(spark, path, FIELDS, chosen, base), *columns) == rows(da.facet_counts(base, FIELDS, chosen), *columns)
    for field in FIELDS:
        got = cube.cube_bar(spark, path, field, chosen, base, {"total": F.col("v")})
        want = da.apply_filters(base, chosen).groupBy(field).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
        assert rows(got, field, "n", "total") == rows(want, field, "n", "total")


def test_cells_of_every_set_sum_to_all_rows(spark, stored):
    path, widest = stored
    for fields in ([], ["a"], ["b", "c"], ["c", "b"], ["a", "b", "c"]):
        cells = cube.cells_of(spark, path, fields)
        if widest is not None and len(fields) > widest:
            assert cells is None
        else:
            assert cells.agg(F.sum("n")).first()[0] == 3000


def test_rows_are_not_scanned_where_the_cube_answers(spark, base):
    path, source = scratch_path(spark, "cube"), scratch_path(spark, "rows")
    base.write.parquet(source)
    rows_ = spark.read.parquet(source)
    cube.store_cube(rows_, path, FIELDS, widest=2)
    narrow = plan_of(cube.cube_facets(spark, path, FIELDS, {"a": ["1"]}, rows_))
    # Cells are read with their counts, rows have none.
    assert narrow.count("FileScan parquet") == 3 == len(re.findall(r"ReadSchema: struct<[^>]*n:bigint", narrow))
    wide = plan_of(cube.cube_facets(spark, path, FIELDS, {"a": ["1"], "b": [1]}, rows_))
    assert wide.count("FileScan parquet") == 3 and len(re.findall(r"ReadSchema: struct<[^>]*n:bigint", wide)) == 2  # only the facet of three fields scans


def test_an_empty_table_has_an_empty_cube(spark, base):
    path = scratch_path(spark, "cube")
    cube.store_cube(base.limit(0), path, FIELDS)
    cells = cube.cells_of(spark, path, ["a"])
    assert cells is None or cells.count() == 0
    assert cube.cube_facets(spark, path, FIELDS, {}, base.limit(0)).count() == 0
