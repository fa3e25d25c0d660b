import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from strataspark.functions import months as mo
from strataspark.operators import cohort as co


def claims_of(rng, n, first, last):
    """Random claims between two years, one person holding a third of them."""
    out = []
    for i in range(n):
        person = "hot" if i % 3 == 0 else f"p{rng.randint(0, 30)}"
        out.append((f"{first}-{i}", person, f"{rng.randint(first, last)}{rng.randint(1, 12):02d}"))
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(8)
    claims = claims_of(rng, 900, 1989, 2004)
    facts = [(r, rng.choice("ab")) for r, _, _ in claims for _ in range(rng.randint(0, 3))]
    frames = spark.createDataFrame(claims, "receipt_id string, common_key string, service_month string"), spark.createDataFrame(facts, "receipt_id string, code string")
    person, month = ({r: v[k] for r, *v in claims} for k in (0, 1))
    want: dict[str, set] = {}
    for r, c in facts:
        if c == "a":
            want.setdefault(person[r], set()).add(month[r])
    return *frames, want


def test_numbers_and_blocks(spark, rows):
    df = spark.createDataFrame([("200001",), ("199912",), ("200013",), ("2000-1",), (None,), ("20001",)], "m string")
    got = {r.m: r.n for r in df.select("m", mo.month_number(F.col("m")).alias("n")).collect()}
    assert got == {"200001": 24000, "199912": 23999, "200013": None, "2000-1": None, None: None, "20001": None}
    assert mo.month_span(df, "m") == ("199912", "200001") and mo.month_span(df.limit(0), "m") is None
    assert mo.blocks_of(("199912", "200001")) == [1995, 2000] and mo.blocks_of(None) == [2000]


@pytest.mark.parametrize("period", [None, ("198901", "200412"), ("190001", "209912")])
def test_months_held_equal_distinct_months(world, period):
    claims, facts, want = world
    got = co.exposure_months(facts, claims, ["a"], period=period)
    assert {r.common_key: r.prescription_months for r in got.collect()} == {p: len(m) for p, m in want.items()}
    assert len(want["hot"]) > 64  # more than one number holds


def test_tables_of_two_periods_merge_to_the_whole(world):
    claims, facts, want = world
    early, late = claims.filter("service_month <= '199706'"), claims.filter("service_month > '199706'")
    parts = [co.exposure_masks(facts, c, ["a"]) for c in (early, late)]
    assert mo.mask_columns(parts[0].columns) == ["months_1985", "months_1990", "months_1995"]
    merged = mo.merge_month_masks(parts, "common_key")
    assert {r.common_key: r.n for r in merged.select("common_key", mo.months_held(merged.columns).alias("n")).collect()} == {
        p: len(m) for p, m in want.items()
    }
    # A run that overlaps another one changes nothing.
    again = mo.merge_month_masks([merged, parts[1]], "common_key")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))


def test_one_exchange_fewer_than_counting_distinct_months(world):
    claims, facts, _ = world
    masks = plan_of(co.exposure_months(facts, claims, ["a"], period=("198901", "200412")))
    dated = co.claims_with(facts.filter("code = 'a'"), claims)
    distinct = plan_of(dated.groupBy("common_key").agg(F.countDistinct("service_month")))
    assert masks.count("Exchange hashpartitioning") == distinct.count("Exchange hashpartitioning") - 1
    assert "partial_bit_or" in masks and "ObjectHash" not in masks


def test_members_facts_meet_their_claims_in_one_join(world, rows):
    claims, facts, want = world
    members = claims.select("common_key").distinct().filter("common_key <> 'p3'")
    plan = plan_of(co.flags_and_months(facts, claims, {"B": ["b"]}, ["a"], own_claims=co.claims_of(claims, members)))
    assert plan.count("Join ") == 2  # the members' claims, and the facts with them
    for given in ({"members": members}, {"own_claims": co.claims_of(claims, members)}):
        got = co.flags_and_months(facts, claims, {"B": ["b"]}, ["a"], **given)
        assert {r.common_key: r.prescription_months for r in got.collect() if r.prescription_months} == {p: len(m) for p, m in want.items() if p != "p3"}
        flags = co.flag_pivot(facts, {"B": ["b"]}, claims=claims, listed_only=True, **given)
        assert rows(flags.filter("B = 1"), "common_key") == rows(got.filter("B = 1"), "common_key")


def test_text_that_is_no_month_counts_as_none(spark, rows):
    claims = spark.createDataFrame([("r1", "p", "201701"), ("r2", "p", "x"), ("r3", "q", None)], "receipt_id string, common_key string, service_month string")
    facts = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r3", "a")], "receipt_id string, code string")
    assert rows(co.exposure_months(facts, claims, ["a"])) == [("p", 1), ("q", 0)]
    assert rows(co.exposure_months(facts.limit(0), claims.limit(0), ["a"])) == []
