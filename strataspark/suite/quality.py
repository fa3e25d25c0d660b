"""Data quality and comparison with published values."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions.hashing import mask_at_rate
from strataspark.functions.scalar import safe_ratio
from strataspark.operators import profile as pr
from strataspark.operators import profile_states as states
from strataspark.operators import rates as ra
from strataspark.operators.report import compare_to_reference, metric_values
from strataspark.session import scratch_path
from strataspark.sources import codes, star
from strataspark.sources.tables import Expectation, scan_table, write_expected
from strataspark.suite.binding import star_master
from strataspark.suite.registry import query
from strataspark.suite.sql import masked, with_


@query(
    "quality_summary",
    """SELECT 'rows' AS "check", CAST(NULL AS VARCHAR) AS item, CAST(COUNT(*) AS DOUBLE) AS value FROM orders
       UNION ALL SELECT 'min_o_totalprice', NULL, MIN(o_totalprice) FROM orders
       UNION ALL SELECT 'max_o_totalprice', NULL, MAX(o_totalprice) FROM orders
       UNION ALL SELECT 'o_orderstatus', o_orderstatus, CAST(COUNT(*) AS DOUBLE) FROM orders GROUP BY o_orderstatus
       UNION ALL SELECT 'o_orderpriority', o_orderpriority, CAST(COUNT(*) AS DOUBLE) FROM orders GROUP BY o_orderpriority""",
)
def _(spark, sf):
    return pr.quality_summary(star.read(spark, sf, "orders"), ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])


# name -> (test, share of the rows that may fail)
EXPECTED = {
    "price_positive": ("o_totalprice > 0", 0.0),
    "priority_listed": ("o_orderpriority IN ('1-URGENT', '2-HIGH')", 0.9),
    "price_below_300000": ("o_totalprice < 300000", 0.9),
}


@query(
    "write_expected",
    " UNION ALL ".join(
        f"SELECT '{name}' AS expectation, (SELECT COUNT(*) FROM orders WHERE NOT coalesce({test}, FALSE)) AS n_failed, (SELECT COUNT(*) FROM orders) AS n_rows, "
        f"(SELECT COUNT(DISTINCT o_orderkey) FROM orders) AS n_published"
        for name, (test, _) in EXPECTED.items()
    ),
)
def _(spark, sf):
    """Store the orders under expectations and read back what was published."""
    target = scratch_path(spark, "expected")
    orders = star.read(spark, sf, "orders")
    counts = write_expected(orders, target, [Expectation(n, F.expr(test), most) for n, (test, most) in EXPECTED.items()], least_rows=1)
    rows = [(name, counts[name], counts["rows"]) for name in EXPECTED]
    found = spark.createDataFrame(rows, "expectation string, n_failed long, n_rows long")
    published = scan_table(spark, target).agg(F.countDistinct("o_orderkey")).scalar()
    return found.withColumn("n_published", published)


BOUNDS = {
    "members": (100.0, None),
    "prevalence_pct": (90.0, 100.0),
    "female_pct": (72.0, 80.0),
    "mtx_pct": (58.0, 68.0),
    "biologics_pct": (20.0, None),
}


@query(
    "expect_range",
    with_("master")
    + """, m AS (SELECT 'members' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM master
         UNION ALL SELECT 'prevalence_pct', round(COUNT(*) * CAST(100 AS DOUBLE) / (SELECT COUNT(*) FROM patients), 2) FROM master
         UNION ALL SELECT 'female_pct', round(avg(CAST(sex = '2' AS INTEGER)) * 100, 1) FROM master
         UNION ALL SELECT 'mtx_pct', round(avg(MTX) * 100, 1) FROM master
         UNION ALL SELECT 'biologics_pct', round(avg(bDMARDs) * 100, 1) FROM master)
       SELECT metric, value, low, high, (low IS NULL OR value >= low) AND (high IS NULL OR value <= high) AS passed
       FROM m JOIN (VALUES ('members', CAST(100 AS DOUBLE), CAST(NULL AS DOUBLE)), ('prevalence_pct', 90, 100),
         ('female_pct', 72, 80), ('mtx_pct', 58, 68), ('biologics_pct', 20, NULL)) b(metric, low, high) USING (metric)""",
)
def _(spark, sf):
    people = star.patients(spark, sf).agg(F.count(F.lit(1))).scalar()
    n = F.count(F.lit(1))
    values = metric_values(
        star_master(spark, sf),
        {
            "members": n,
            "prevalence_pct": safe_ratio(n, people, 100.0, 2),
            "female_pct": F.round(F.avg((F.col("sex") == "2").cast("int")) * 100, 1),
            "mtx_pct": F.round(F.avg("MTX") * 100, 1),
            "biologics_pct": F.round(F.avg("bDMARDs") * 100, 1),
        },
    )
    return pr.expect_range(values, BOUNDS)


@query(
    "null_report",
    f"""WITH e AS (SELECT event_id, {masked('value', 'event_id', 'value', 0.12)} AS value,
            {masked('event_type', 'event_id', 'type', 0.03)} AS event_type, user_id FROM events),
        c AS (SELECT 'value' AS column_name, COUNT(*) - COUNT(value) AS missing_count FROM e
          UNION ALL SELECT 'event_type', COUNT(*) - COUNT(event_type) FROM e),
        p AS (SELECT *, CAST(round_even(missing_count * CAST(100 AS DOUBLE) / (SELECT COUNT(*) FROM e), 2) AS DOUBLE) AS missing_pct FROM c)
        SELECT *, CASE WHEN (SELECT MAX(missing_pct) FROM p) < 10 THEN 'impute' ELSE 'review' END AS verdict FROM p""",
)
def _(spark, sf):
    key = F.col("event_id")
    holed = star.read(spark, sf, "events").select(
        "event_id",
        "user_id",
        mask_at_rate(F.col("value"), key, "value", 0.12).alias("value"),
        mask_at_rate(F.col("event_type"), key, "type", 0.03).alias("event_type"),
    )
    return pr.missing_profile(holed)


@query(
    "compare_to_reference",
    with_("master")
    + "SELECT t.age_group, t.v AS reproduced, r.v AS published, round(t.v - r.v, 2) AS difference FROM "
    + "(SELECT age_group, round(avg(MTX) * 100, 1) AS v FROM master GROUP BY age_group) t JOIN (VALUES "
    + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in codes.PUBLISHED_MTX.items())
    + ") r(age_group, v) USING (age_group)",
)
def _(spark, sf):
    rates = ra.stratified_rates(star_master(spark, sf), "age_group", ["MTX"], 1)
    return compare_to_reference(rates, "age_group", "MTX", codes.PUBLISHED_MTX)


def _profile_sql(column: str, numeric: bool) -> str:
    numbers = {"min": f"MIN({column})", "max": f"MAX({column})", "mean": f"round(avg({column}), 6)", "std": f"round(stddev_samp({column}), 6)"}
    values = ", ".join(f"CAST({v if numeric else 'NULL'} AS DOUBLE) AS {k}" for k, v in numbers.items())
    return f"SELECT '{column}' AS column_name, COUNT(*) AS rows, COUNT({column}) AS n, COUNT(*) - COUNT({column}) AS nulls, {values} FROM lineitem"


@query(
    "profile_merged",
    " UNION ALL ".join(_profile_sql(c, c != "l_returnflag") for c in ("l_quantity", "l_extendedprice", "l_returnflag")),
)
def _(spark, sf):
    """A profile of the lines united from the states of their years; the exact part of it."""
    lines, path = star.read(spark, sf, "lineitem"), scratch_path(spark, "states")
    dated = lines.withColumn("year", F.year("l_shipdate"))
    # A few years: each is a part, as if it had arrived by itself.
    for year in sorted(r["year"] or 0 for r in dated.select("year").distinct().collect()):
        part = dated.filter(F.coalesce("year", F.lit(0)) == year)
        states.store_states(part, path, f"y{year}", ["l_quantity", "l_extendedprice", "l_returnflag"])
    merged = states.stored_profile(spark, path)
    return merged.select("column_name", "rows", "n", "nulls", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
