import random

import pytest
from pyspark.sql import functions as F

from strataspark.operators import cohort as co
from strataspark.operators import joins as jo

GROUPS = {"A": ["a1", "a2"], "B": ["b1"], "NONE": ["zz"]}


@pytest.fixture(scope="module")
def world(spark):
    """Random claims with one claim holding a third of all facts, plus brute-force answers."""
    rng = random.Random(4)
    claims = [(f"r{i}", f"p{rng.randint(0, 19)}", f"2017{rng.randint(1, 12):02d}") for i in range(120)]
    facts = [(f"r{rng.randint(0, 119)}", rng.choice(["a1", "a2", "b1", "x"])) for _ in range(300)]
    facts += [("r0", "a1")] * 150
    person = {r: p for r, p, _ in claims}
    month = {r: m for r, _, m in claims}
    claims_df = spark.createDataFrame(claims, "receipt_id string, common_key string, service_month string")
    by_claim = spark.createDataFrame(facts, "receipt_id string, code string")
    by_person = spark.createDataFrame(
        [(r, person[r], c) for r, c in facts], "receipt_id string, common_key string, code string"
    )
    return claims_df, by_claim, by_person, facts, person, month


@pytest.mark.parametrize("keyed", [False, True])
def test_cohort_by_code(world, rows, keyed):
    claims, by_claim, by_person, facts, person, _ = world
    want = sorted({person[r] for r, c in facts if c == "b1"})
    got = co.cohort_by_code(by_person if keyed else by_claim, ["b1"], claims=claims)
    assert [r[0] for r in rows(got)] == want


@pytest.mark.parametrize("keyed", [False, True])
def test_exposure_months(world, rows, keyed):
    claims, by_claim, by_person, facts, person, month = world
    want: dict[str, set] = {}
    for r, c in facts:
        if c in ("a1", "a2"):
            want.setdefault(person[r], set()).add(month[r])
    got = co.exposure_months(by_person if keyed else by_claim, claims, ["a1", "a2"])
    assert dict(rows(got)) == {p: len(m) for p, m in want.items()}


@pytest.mark.parametrize("keyed", [False, True])
def test_flags_and_months_equal_the_separate_operators(world, rows, keyed):
    claims, by_claim, by_person, *_ = world
    facts = by_person if keyed else by_claim
    names = list(GROUPS)
    flags = co.flag_pivot(facts, GROUPS, listed_only=True, claims=claims)
    months = co.exposure_months(facts, claims, ["a1", "a2"])
    want = flags.join(months, "common_key", "left").fillna(0, ["prescription_months"])
    got = co.flags_and_months(facts, claims, GROUPS, ["a1", "a2"])
    columns = ["common_key", "prescription_months", *names]
    assert rows(got, *columns) == rows(want, *columns)


def test_flags_keep_zero_columns_and_values(world, rows):
    claims, by_claim, _, facts, person, _ = world
    got = {r[0]: r[1:] for r in rows(co.flag_pivot(by_claim, GROUPS, claims=claims), "common_key", *GROUPS)}
    assert set(got) == {person[r] for r, _ in facts}
    for p, values in got.items():
        held = {c for r, c in facts if person[r] == p}
        assert values == (int(bool(held & {"a1", "a2"})), int("b1" in held), 0)


def test_fact_with_unknown_claim_keeps_flags(spark, rows):
    claims = spark.createDataFrame([("r1", "p1", "201701")], "receipt_id string, common_key string, service_month string")
    facts = spark.createDataFrame([("gone", "p1", "b1")], "receipt_id string, common_key string, code string")
    got = co.flags_and_months(facts, claims, {"B": ["b1"]}, ["b1"])
    assert rows(got, "common_key", "prescription_months", "B") == [("p1", 0, 1)]


def test_thresholds_fall_and_start_at_candidates(world, rows):
    claims, by_claim, *_ = world
    found = co.cohort_by_code(by_claim, ["b1"], claims=claims)
    months = co.exposure_months(by_claim, claims, ["a1"])
    sizes = [n for _, n in sorted(rows(co.threshold_sensitivity(co.with_exposure(found, months), [0, 1, 2, 3, 6])))]
    assert sizes[0] == found.count()
    assert sizes == sorted(sizes, reverse=True)
    for t, n in zip([1, 2, 3, 6], sizes[1:]):
        assert co.cohort_by_exposure(found, months, t).count() == n


def test_definition_summary_of_nobody(spark, rows):
    keys = spark.createDataFrame([], "common_key string")
    months = spark.createDataFrame([], "common_key string, prescription_months long")
    got = co.definition_summary(co.with_exposure(keys, months), keys, {"def_0": 0, "def_2": 1})
    assert rows(got) == [("def_0", 0, None), ("def_2", 0, None)]


def test_attrition_is_monotone_and_null_fails(spark, rows):
    df = spark.createDataFrame([(39, "01"), (40, None), (41, "13"), (None, "13")], "age int, pref string")
    steps = [("40+", F.col("age") >= 40), ("pref", F.col("pref").isNotNull())]
    assert rows(co.attrition_cascade(df, steps)) == [(0, "all", 4), (1, "40+", 2), (2, "pref", 1)]


def test_master_fills_flags_without_facts(spark, rows):
    members = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "common_key int, prescription_months int")
    persons = spark.createDataFrame([(1, 30), (2, 40), (3, 50), (4, 60)], "common_key int, age int")
    flags = spark.createDataFrame([(2, 1, 0)], "common_key int, A int, B int")
    got = co.cohort_master(members, persons, [(flags, ["A", "B"])], {"any": ["A", "B"]})
    assert rows(got) == [(1, 2, 30, 0, 0, 0), (2, 3, 40, 1, 0, 1), (3, 2, 50, 0, 0, 0)]


def test_panel_counts_every_month(spark, rows):
    people = spark.createDataFrame([(1,), (2,)], "k int")
    visits = spark.createDataFrame([(1, "201712"), (1, "201712"), (1, "201801"), (9, "201712"), (2, "201703")], "k int, m string")
    got = jo.activity_panel(people, visits, "k", "201711", "201801", month="m")
    assert rows(got) == [
        (1, "201711", 0), (1, "201712", 2), (1, "201801", 1), (2, "201711", 0), (2, "201712", 0), (2, "201801", 0),
    ]
    assert rows(jo.entity_panel(people, "201711", "201801", "m")) == [r[:2] for r in rows(got)]


def test_salted_join_equals_plain_join(spark, rows):
    facts = spark.createDataFrame([("hot", i, i % 3) for i in range(60)] + [("cold", 1, 1), ("gone", 1, 1)], "r string, line int, v int")
    claims = spark.createDataFrame([("hot", "p1"), ("cold", "p2"), ("empty", "p3")], "r string, p string")
    columns = ["r", "line", "v", "p"]
    salted = jo.join_facts(facts, claims, "r", salts=4, spread_by=["line"])
    assert rows(salted, *columns) == rows(jo.join_facts(facts, claims, "r"), *columns)
    with pytest.raises(ValueError):
        jo.join_facts(facts, claims, "r", salts=4)


def test_semi_does_not_multiply(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    keys = spark.createDataFrame([(1,), (1,), (1,)], "k int")
    assert rows(jo.semi(df, keys, "k")) == [(1, "x")]


def test_more_groups_than_bits_in_one_number(spark):
    groups = {f"g{i}": [f"c{i}", "all"] for i in range(130)}
    facts = spark.createDataFrame([(1, "c0"), (1, "c61"), (1, "c62"), (1, "c129"), (2, "all"), (3, "none")], "common_key int, code string")
    got = {r["common_key"]: r.asDict() for r in co.flag_pivot(facts, groups).collect()}
    assert {k for k, v in got[1].items() if v == 1 and k != "common_key"} == {"g0", "g61", "g62", "g129"}
    assert all(got[2][g] == 1 for g in groups) and all(got[3][g] == 0 for g in groups)
