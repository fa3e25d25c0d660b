"""The shape of the physical plans: what is scanned, shuffled and broadcast."""

import re

import pytest

from conftest import plan_of
from strataspark.suite import ORACLE, QUERIES

class Plans(dict):
    """Plans of the queries asked for, as with tables too large to broadcast by size."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    def __missing__(self, name):
        former = self.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        self.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            self[name] = plan_of(QUERIES[name](self.spark, self.sf))
        finally:
            self.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", former)
        return self[name]


@pytest.fixture(scope="module")
def plans(spark, sf):
    return Plans(spark, sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_code_filters_reach_the_scan(plans):
    assert re.search(r"PushedFilters: \[[^\]]*In\(p_brand", plans["cohort_by_code"])
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(p_type,ECONOMY\)", plans["exposure_months"])


def test_scans_read_only_needed_columns(plans):
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plans["exposure_months"]
    assert "ReadSchema: struct<o_orderstatus:string>" in plans["count_rows"] or "o_totalprice" in plans["count_rows"]
    assert "l_comment" not in plans["group_count"] and "l_quantity" not in plans["group_count"]


def test_one_scan_per_fact(plans):
    assert plans["definition_summary"].count("lineitem.parquet") == 2  # diagnoses and drugs
    assert plans["cohort_master"].count("lineitem.parquet") == 1  # procedures; diagnoses and drugs are stored
    assert plans["facet_counts"].count("customer.parquet") == 1
    assert plans["quality_summary"].count("orders.parquet") == 1


def test_facts_meet_claims_only_after_aggregation(plans):
    # Below the join on the claim key, facts are already one row per claim.
    for name in ("cohort_by_code", "exposure_months"):
        assert re.search(r"LeftSemi[\s\S]*HashAggregate\(keys=\[receipt_id", plans[name]), name
    assert re.search(r"HashAggregate\(keys=\[receipt_id[^\]]*\], functions=\[partial_bit_or", plans["flag_pivot"])


def test_picks_are_ranked_by_key_and_digits(plans):
    for name in ("stratified_sample", "pick_n_per_key"):
        assert re.search(r"Window \[row_number\(\)[^\n]*\[__k#\d+, __part#\d+\]", plans[name]), name


def test_panel_needs_no_join(plans):
    assert "Join" not in plans["join_cross_panel"] and "Exchange" not in plans["join_cross_panel"]


def test_row_functions_do_not_shuffle(plans):
    for name in ("bin_floor", "keyed_uniform", "calendar_parts", "hash_sample", "mask_at_rate", "band_left_closed", "pseudonym_key"):
        assert "Exchange" not in plans[name], name
