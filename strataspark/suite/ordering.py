"""Window functions, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.operators import cohort as co
from strataspark.operators import rates as ra
from strataspark.operators.sampling import pick_n_per_key
from strataspark.operators.survival import event_table, running_sums
from strataspark.plans import claims
from strataspark.sources import codes, star
from strataspark.suite.binding import STAR_SPEC, star_claims
from strataspark.suite.registry import query
from strataspark.suite.sql import ordinal, uniform, with_


@query(
    "share_of_total",
    with_("patients")
    + """SELECT age_group, COUNT(*) AS n, round(COUNT(*) * CAST(100 AS DOUBLE) / SUM(COUNT(*)) OVER (), 1) AS pct
         FROM patients GROUP BY age_group""",
)
def _(spark, sf):
    return ra.share_of_total(star.patients(spark, sf), "age_group")


@query(
    "pick_n_per_key",
    f"""SELECT o_custkey, o_orderkey, pick FROM (SELECT o_custkey, o_orderkey, CAST(1 + o_custkey % 4 AS INTEGER) AS n,
          CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY {uniform('o_orderkey', 'pick')}, o_orderkey) AS INTEGER) AS pick
        FROM orders) x WHERE pick <= n""",
)
def _(spark, sf):
    orders = star.read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    n = (1 + F.col("o_custkey") % 4).cast("int")
    return pick_n_per_key(orders, "o_custkey", "o_orderkey", "pick", n)


@query(
    "km_running",
    with_("survival")
    + """, per_time AS (SELECT grp, months AS t, COUNT(*) AS leaving, SUM(event) AS d FROM survival GROUP BY grp, months),
         risk AS (SELECT *, SUM(leaving) OVER (PARTITION BY grp ORDER BY t DESC) AS n FROM per_time)
       SELECT grp, t, CAST(n AS BIGINT) AS n_at_risk,
         CAST(SUM(d) OVER (PARTITION BY grp ORDER BY t) AS BIGINT) AS events_so_far,
         round(SUM(CAST(d AS DOUBLE) / n) OVER (PARTITION BY grp ORDER BY t), 9) AS cumulative_hazard FROM risk""",
)
def _(spark, sf):
    events = event_table(star.survival_input(spark, sf), "months", "event", ["grp"])
    sums = {"events_so_far": F.col("n_events"), "hazard": F.col("n_events") / F.col("n_at_risk")}
    return running_sums(events, ["grp"], "t", sums).select(
        "grp", "t", "n_at_risk", "events_so_far", F.round("hazard", 9).alias("cumulative_hazard")
    )


@query(
    "order_by_ordinal",
    with_("patients")
    + f""", c AS (SELECT age_group, COUNT(*) AS n FROM patients GROUP BY age_group UNION ALL SELECT 'Total', COUNT(*) FROM patients)
        SELECT age_group, n, {ordinal('age_group', codes.AGE_LABELS)} AS sort_key FROM c ORDER BY sort_key""",
)
def _(spark, sf):
    table = ra.rates_with_total(star.patients(spark, sf), "age_group", [], codes.AGE_LABELS)
    return ra.order_by_ordinal(table, "age_group", codes.AGE_LABELS)


@query(
    "order_by_desc",
    "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand",
)
def _(spark, sf):
    return ra.order_by_desc(ra.group_count(star.read(spark, sf, "part"), ["p_brand"]), "n", "p_brand")


@query(
    "top_k_categories",
    with_("chronic")
    + """, top AS (SELECT comorbidity_pattern, COUNT(*) AS n FROM chronic GROUP BY comorbidity_pattern
           ORDER BY n DESC, comorbidity_pattern LIMIT 5)
       SELECT patient_id, comorbidity_pattern FROM chronic WHERE comorbidity_pattern IN (SELECT comorbidity_pattern FROM top)""",
)
def _(spark, sf):
    cohort = star.chronic_cohort(spark, sf).select("patient_id", "comorbidity_pattern")
    return ra.rows_of_top_k(cohort, "comorbidity_pattern", 5)


@query(
    "top_codes_limit",
    with_("disease") + "SELECT code, COUNT(*) AS n FROM disease GROUP BY code ORDER BY n DESC, code LIMIT 10",
)
def _(spark, sf):
    return ra.top_k(star.disease_lines(spark, sf), "code", 10)


@query(
    "latest_definition_order",
    with_("def0", "months")
    + """, held AS (SELECT COALESCE(prescription_months, 0) AS m FROM def0 LEFT JOIN months USING (common_key))
       SELECT d.definition, COUNT(*) FILTER (m >= t) AS n_patients
       FROM held, (VALUES ('def_0', 0), ('def_2', 1), ('def_3', 2), ('def_4', 6)) d(definition, t)
       GROUP BY d.definition ORDER BY d.definition""",
)
def _(spark, sf):
    return claims.definitions(star_claims(spark, sf), STAR_SPEC).select("definition", "n_patients").orderBy("definition")


@query(
    "union_positional",
    """SELECT l_orderkey AS receipt_id, 'A' AS procedure_type FROM lineitem WHERE l_returnflag = 'A'
       UNION ALL SELECT l_orderkey, 'BULK' FROM lineitem WHERE l_quantity >= 40
       UNION ALL SELECT o_orderkey, 'VISIT' FROM orders""",
)
def _(spark, sf):
    lines, orders = star.read(spark, sf, "lineitem"), star.read(spark, sf, "orders")
    receipt = F.col("l_orderkey").alias("receipt_id")
    # Both line branches come from one scan: each row unfolds into the types it earns.
    earned = F.array_compact(
        F.array(F.when(F.col("l_returnflag") == "A", F.lit("A")), F.when(F.col("l_quantity") >= 40, F.lit("BULK")))
    )
    typed = lines.select(receipt, F.explode(earned).alias("procedure_type"))
    visits = orders.select(F.col("o_orderkey").alias("receipt_id"), F.lit("VISIT").alias("procedure_type"))
    return typed.unionByName(visits)


@query(
    "union_all_sql",
    with_("def0", "months", "patients")
    + """, held AS (SELECT COALESCE(prescription_months, 0) AS m FROM def0 LEFT JOIN months USING (common_key))
       SELECT 'diagnosis' AS definition, COUNT(*) AS n FROM def0
       UNION ALL SELECT 'one month', COUNT(*) FROM held WHERE m >= 1
       UNION ALL SELECT 'everybody', COUNT(*) FROM patients""",
)
def _(spark, sf):
    tables = star_claims(spark, sf)
    exposed = co.with_exposure(claims.candidates(tables, STAR_SPEC), claims.exposure(tables, STAR_SPEC))
    # The two counts of one population share a pass; only the other population is a branch.
    counted = co.definition_summary(exposed, tables.patients, {"diagnosis": 0, "one month": 1})
    people = tables.patients.agg(F.count(F.lit(1)).alias("n")).select(F.lit("everybody").alias("definition"), "n")
    return counted.select("definition", F.col("n_patients").alias("n")).unionByName(people)
