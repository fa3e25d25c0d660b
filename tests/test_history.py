import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from strataspark.session import scratch_path
from strataspark.sources import history

DAYS = ["2024-01-01", "2024-01-02", "2024-01-05", "2024-01-06", "2024-01-09"]


def states():
    """A state a day: rows come, change (also from and to null), go and come back."""
    rng = random.Random(3)
    state, out = {}, []
    for d in range(len(DAYS)):
        for i in range(120):
            chance = rng.random()
            key = (i, None if i % 7 == 0 else f"s{i % 3}")
            if key not in state and chance < 0.5 or key in state and chance < 0.05:
                state[key] = (rng.choice([None, "", "x", "y"]), rng.choice([None, 0.0, 1.5]))
            elif chance > 0.97:
                state.pop(key, None)
        out.append(dict(state))
    return out


def frame(spark, state):
    return spark.createDataFrame([(*k, *v) for k, v in state.items()], "id int, part string, label string, amount double")


@pytest.fixture(scope="module")
def store(spark):
    path = scratch_path(spark, "history")
    for day, state in zip(DAYS, states()):
        history.store_changes(frame(spark, state), path, day, ["id", "part"])
    return path


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("based", [False, True])
def test_every_day_equals_its_full_copy(spark, store, based):
    if based:
        history.store_base(spark, store, DAYS[2])
    for day, state in zip(DAYS, states()):
        assert as_rows(history.state_as_of(spark, store, day)) == as_rows(frame(spark, state)), day
    assert as_rows(history.state_as_of(spark, store, "2024-01-04")) == as_rows(frame(spark, states()[1]))
    assert history.state_as_of(spark, store, "2023-12-31").count() == 0


def test_a_day_stores_its_changes_only(spark, store):
    counts = {}
    for r in history.change_counts(spark, store).collect():
        counts.setdefault(str(r.change_date), {})[r.kind] = r.n
    before = {}
    for day, state in zip(DAYS, states()):
        want = {
            "inserted": len(state.keys() - before.keys()),
            "removed": len(before.keys() - state.keys()),
            "changed": sum(before[k] != state[k] for k in state.keys() & before.keys()),
        }
        assert counts.get(day, {}) == {k: n for k, n in want.items() if n}
        before = state
    assert sum(counts[DAYS[-1]].values()) < len(before) / 2


def test_a_day_again_replaces_that_day(spark):
    path = scratch_path(spark, "again")
    a, b = ({(i, "s"): (str(v), 1.0) for i in range(5)} for v in (1, 2))
    history.store_changes(frame(spark, a), path, "2024-01-01", ["id", "part"])
    for state in (a, b):
        history.store_changes(frame(spark, state), path, "2024-01-02", ["id", "part"])
        if state is a:  # nothing changed: nothing is stored
            assert history.change_counts(spark, path).count() == 1
    assert as_rows(history.state_as_of(spark, path, "2024-01-02")) == as_rows(frame(spark, b))
    assert as_rows(history.state_as_of(spark, path, "2024-01-01")) == as_rows(frame(spark, a))


def test_keys_must_be_unique_and_names_free(spark):
    path = scratch_path(spark, "twice")
    with pytest.raises(Exception, match="key occurs twice"):
        history.store_changes(spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string"), path, "2024-01-01", ["id"])
    with pytest.raises(ValueError):
        history.store_changes(spark.createDataFrame([(1, "a")], "id int, change_date string"), path, "2024-01-01", ["id"])
    with pytest.raises(ValueError):
        history.state_as_of(spark, scratch_path(spark, "none"), "2024-01-01")


def test_days_are_pruned(spark, store):
    plan = plan_of(history.state_as_of(spark, store, DAYS[1]))
    assert "PartitionFilters: [isnotnull(change_date" in plan and "partial_max_by" in plan
