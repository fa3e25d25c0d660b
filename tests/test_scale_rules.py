"""Rules that keep results and plans the same at every size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import ranges
from strataspark import session
from strataspark.operators import cohort as co
from strataspark.operators import dashboard as da
from strataspark.operators import survival as su
from strataspark.plans import claims
from strataspark.suite.binding import STAR_SPEC, star_claims


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_curves_survive_billions_at_risk(spark):
    events = spark.createDataFrame(
        [(1, 4_000_000_000, 1_000_000_000, 0), (2, 3_000_000_000, 3, 5)], "t long, n_at_risk long, n_events long, n_censored long"
    )
    rows = su._curve(events, (), True).orderBy("t").collect()
    assert [r.survival for r in rows] == pytest.approx([1.0, 0.75, 0.75 * (1 - 1e-9)])
    assert rows[1].greenwood == pytest.approx(1e9 / 4e9 / 3e9)


def test_ranges_change_nothing_with_an_origin(spark):
    df = spark.range(500).select((F.col("id") % 97 + 1).alias("m"), (F.col("id") % 3 == 0).cast("int").alias("e"), (F.col("id") % 2).alias("g"))
    want = {(r.g, r.t): (r.n_at_risk, round(r.survival, 9)) for r in su.kaplan_meier(df, "m", "e", ["g"]).collect()}
    with ranges(spark, 9):
        got = su.kaplan_meier(df, "m", "e", ["g"])
        assert {(r.g, r.t): (r.n_at_risk, round(r.survival, 9)) for r in got.collect()} == want
        assert "row_number" not in plan_of(got)
        patterns = su.km_by_pattern(df, "m", "e", "g")
        assert {(r.g, r.t): (r.n_at_risk, round(r.survival, 9)) for r in patterns.collect()} == want


def test_subgroups_in_ranges(spark):
    df = spark.range(400).select(
        (F.col("id") % 53).alias("m"), (F.col("id") % 4 == 0).cast("int").alias("e"), (F.col("id") % 2).alias("g"), (F.col("id") % 5).alias("s")
    )
    one = {r.s: round(r.chi2, 9) for r in su.subgroup_logrank(df, "m", "e", "g", 0, 1, "s").collect()}
    with ranges(spark, 11):
        assert {r.s: round(r.chi2, 9) for r in su.subgroup_logrank(df, "m", "e", "g", 0, 1, "s").collect()} == one


def test_threshold_zero_keeps_every_candidate(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "common_key long")
    months = spark.createDataFrame([(1, 4), (2, 1)], "common_key long, prescription_months long")
    sizes = [co.cohort_by_exposure(people, months, k).count() for k in (0, 1, 2, 5)]
    assert sizes == [3, 2, 1, 0]
    assert {r.prescription_months for r in co.cohort_by_exposure(people, months, 0).collect()} == {4, 1, 0}


def test_member_counts_agree_at_threshold_zero(spark, sf):
    import dataclasses

    spec = dataclasses.replace(STAR_SPEC, min_months=0)
    tables = star_claims(spark, sf)
    assert claims.members(tables, spec).count() == claims.candidates(tables, spec).count() == claims.master(tables, spec).count()


def test_facts_are_restricted_before_they_are_aggregated(spark, sf):
    tables = star_claims(spark, sf)
    few = claims.candidates(tables, STAR_SPEC)
    flags = co.flag_pivot(tables.procedure, STAR_SPEC.procedure_groups, listed_only=True, claims=tables.receipts, members=few)
    lines = plan_of(flags).splitlines()
    first_aggregate = max(i for i, line in enumerate(lines) if "partial_bit_or" in line)
    assert any("LeftSemi" in line for line in lines[first_aggregate:])
    want = co.flag_pivot(tables.procedure, STAR_SPEC.procedure_groups, listed_only=True, claims=tables.receipts).join(few, "common_key", "left_semi")
    assert sorted(map(tuple, flags.collect())) == sorted(map(tuple, want.collect()))


def test_facets_are_counted_in_one_scan(spark):
    df = spark.range(90).select((F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 5).cast("string").alias("b"))
    found = da.facet_counts(df, ["a", "b"], {"a": ["1"]})
    assert plan_of(found).count("Range (") == 1
    assert {(r.facet, r.value): r.n_matching for r in found.collect()} == {
        **{("a", str(i)): 30 for i in range(3)}, **{("b", str(i)): 6 for i in range(5)},
    }


def test_cluster_settings():
    assert session.CLUSTER_CONF["spark.sql.adaptive.coalescePartitions.parallelismFirst"] == "false"
    assert session.INITIAL_PARTITIONS >= 1000


def test_scratch_can_be_dropped(spark, tmp_path, monkeypatch):
    import os

    root = f"{tmp_path}/strataspark/app-1"
    monkeypatch.setattr(session, "scratch_root", lambda _: root)
    path = session.scratch_path(spark, "x")
    spark.sql(f"CREATE DATABASE scratch_x LOCATION '{path}'")
    spark.range(3).write.saveAsTable("scratch_x.t")
    assert os.path.isdir(path) and path.startswith(root)
    session.drop_scratch(spark)
    assert not os.path.exists(root)
    assert "scratch_x" not in {d.name for d in spark.catalog.listDatabases()}


def test_shared_folder_is_the_sessions(spark):
    assert session.scratch_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
