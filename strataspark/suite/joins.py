"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions.scalar import safe_ratio
from strataspark.operators import cohort as co
from strataspark.operators import joins as jo
from strataspark.operators.rates import stratified_rates
from strataspark.sources import codes, star
from strataspark.suite.registry import query
from strataspark.suite.sql import with_


@query(
    "join_inner_fact",
    with_("medication") + "SELECT code, service_month, COUNT(*) AS n FROM medication GROUP BY code, service_month",
)
def _(spark, sf):
    joined = jo.join_facts(star.medication_lines(spark, sf), star.receipts(spark, sf), "receipt_id")
    return joined.groupBy("code", "service_month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join_hot_keys",
    """SELECT n_name, COUNT(*) AS n, SUM(l_quantity) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def _(spark, sf):
    lines = star.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    suppliers = star.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    facts = lines.join(suppliers, "l_suppkey")
    # Twenty-five nations share all lines: every key is hot.
    nations = star.read(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = jo.join_hot(facts, nations, "n_nationkey", ["l_orderkey", "l_linenumber"])
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    "join_inner_keyed",
    with_("def0", "months") + "SELECT common_key, prescription_months FROM def0 JOIN months USING (common_key)",
)
def _(spark, sf):
    receipts = star.receipts(spark, sf)
    found = co.cohort_by_code(star.disease_lines(spark, sf), star.DIAGNOSIS_BRANDS, claims=receipts)
    months = co.exposure_months(star.medication_lines(spark, sf), receipts, star.EXPOSURE_TYPES)
    return found.join(months, "common_key")


@query(
    "join_left_enrich",
    with_("patients", "months", "proc_flags")
    + """SELECT p.common_key, p.age_group, m.prescription_months, f.TJR, f.BMD, f.VISIT FROM patients p
         LEFT JOIN months m USING (common_key) LEFT JOIN proc_flags f USING (common_key)""",
)
def _(spark, sf):
    receipts = star.receipts(spark, sf)
    months = co.exposure_months(star.medication_lines(spark, sf), receipts, star.EXPOSURE_TYPES)
    flags = co.flag_pivot(star.procedure_lines(spark, sf), star.RETURN_FLAGS, claims=receipts)
    return jo.enrich(star.patients(spark, sf).select("common_key", "age_group"), [months, flags], "common_key")


@query(
    "join_semi_in",
    with_("def0") + "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT common_key FROM def0)",
)
def _(spark, sf):
    found = co.cohort_by_code(
        star.disease_lines(spark, sf), star.DIAGNOSIS_BRANDS, claims=star.receipts(spark, sf)
    )
    orders = star.read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return jo.semi(orders, found.select(F.col("common_key").alias("o_custkey")), "o_custkey")


@query(
    "join_cross_panel",
    """SELECT c_custkey, strftime(m, '%Y%m') AS service_month FROM customer,
         (SELECT unnest(generate_series(DATE '1996-04-01', DATE '1997-03-01', INTERVAL 1 MONTH)) AS m) t""",
)
def _(spark, sf):
    return jo.entity_panel(star.read(spark, sf, "customer").select("c_custkey"), "199604", "199703")


@query(
    "join_left_lookup",
    with_("members", "patients")
    + "SELECT a.age_group, a.n, b.n_pop, r.v AS published FROM (SELECT age_group, COUNT(*) AS n FROM patients "
    + "WHERE common_key IN (SELECT common_key FROM members) GROUP BY age_group) a "
    + "LEFT JOIN (SELECT age_group, COUNT(*) AS n_pop FROM patients GROUP BY age_group) b USING (age_group) LEFT JOIN (VALUES "
    + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in codes.PUBLISHED_MTX.items())
    + ") r(age_group, v) USING (age_group)",
)
def _(spark, sf):
    receipts, persons = star.receipts(spark, sf), star.patients(spark, sf)
    members = co.cohort_by_exposure(
        co.cohort_by_code(star.disease_lines(spark, sf), star.DIAGNOSIS_BRANDS, claims=receipts),
        co.exposure_months(star.medication_lines(spark, sf), receipts, star.EXPOSURE_TYPES),
        2,
    )
    counted = co.restrict_population(persons, members).groupBy("age_group").agg(F.count(F.lit(1)).alias("n"))
    people = persons.groupBy("age_group").agg(F.count(F.lit(1)).alias("n_pop"))
    published = codes.reference_values(spark, codes.PUBLISHED_MTX, "age_group", ["published"])
    return jo.lookup_left(jo.lookup_left(counted, people, ["age_group"]), published, ["age_group"])


@query(
    "join_inner_reference",
    with_("patients", "drug_flags")
    + "SELECT t.age_group, t.mtx, r.v AS mtx_published FROM (SELECT age_group, round(avg(MTX) * 100, 1) AS mtx FROM patients "
    + "JOIN drug_flags USING (common_key) GROUP BY age_group) t JOIN (VALUES "
    + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in codes.PUBLISHED_MTX.items())
    + ") r(age_group, v) USING (age_group)",
)
def _(spark, sf):
    facts = star.medication_lines(spark, sf)
    flags = co.flag_pivot(facts, {"mtx": ["ECONOMY"]}, claims=star.receipts(spark, sf))
    rates = stratified_rates(star.patients(spark, sf).join(flags, "common_key"), "age_group", ["mtx"], 1)
    published = codes.reference_values(spark, codes.PUBLISHED_MTX, "age_group", ["mtx_published"])
    return jo.lookup_inner(rates.select("age_group", "mtx"), published, ["age_group"])


@query(
    "scalar_subquery",
    with_("def0")
    + """SELECT (SELECT COUNT(*) FROM def0) AS n_patients,
           round((SELECT COUNT(*) FROM def0) * CAST(100 AS DOUBLE) / (SELECT COUNT(*) FROM customer), 2) AS prevalence_pct""",
)
def _(spark, sf):
    found = co.cohort_by_code(
        star.disease_lines(spark, sf), star.DIAGNOSIS_BRANDS, claims=star.receipts(spark, sf)
    )
    people = star.read(spark, sf, "customer").agg(F.count(F.lit(1))).scalar()
    return found.agg(F.count(F.lit(1)).alias("n_patients")).withColumn(
        "prevalence_pct", safe_ratio(F.col("n_patients"), people, 100.0, 2)
    )
