"""Cohort definition."""

from __future__ import annotations

from strataspark.operators import cohort as co
from strataspark.plans import claims, survival_study
from strataspark.sources import star
from strataspark.suite.binding import STAR_SPEC, star_claims, star_master
from strataspark.suite.registry import query
from strataspark.suite.sql import with_


@query("cohort_by_code", with_("def0") + "SELECT common_key FROM def0")
def _(spark, sf):
    return claims.candidates(star_claims(spark, sf), STAR_SPEC)


@query("cohort_by_exposure", with_("members") + "SELECT common_key, prescription_months FROM members")
def _(spark, sf):
    return claims.members(star_claims(spark, sf), STAR_SPEC)


@query(
    "threshold_sensitivity",
    with_("def0", "months")
    + """, held AS (SELECT COALESCE(prescription_months, 0) AS m FROM def0 LEFT JOIN months USING (common_key))
       SELECT t.threshold, COUNT(*) FILTER (m >= threshold) AS n_patients
       FROM held, (VALUES (0), (1), (2), (3), (6), (12)) t(threshold) GROUP BY t.threshold""",
)
def _(spark, sf):
    tables = star_claims(spark, sf)
    exposed = co.with_exposure(claims.candidates(tables, STAR_SPEC), claims.exposure(tables, STAR_SPEC))
    return co.threshold_sensitivity(exposed, [0, 1, 2, 3, 6, 12])


@query(
    "attrition_cascade",
    with_("chronic")
    + """SELECT 0 AS step, 'all' AS criterion, COUNT(*) AS n_remaining FROM chronic
       UNION ALL SELECT 1, 'age 40+', COUNT(*) FROM chronic WHERE age >= 40
       UNION ALL SELECT 2, 'diagnosed by 1995-12-31', COUNT(*) FROM chronic WHERE age >= 40 AND diabetes_diagnosis_date <= DATE '1995-12-31'
       UNION ALL SELECT 3, 'prefecture known', COUNT(*) FROM chronic WHERE age >= 40
         AND diabetes_diagnosis_date <= DATE '1995-12-31' AND prefecture_code IS NOT NULL""",
)
def _(spark, sf):
    return survival_study.attrition(star.chronic_cohort(spark, sf), 40, "1995-12-31")


@query("cohort_master", with_("master") + "SELECT * FROM master")
def _(spark, sf):
    return star_master(spark, sf)


@query(
    "restrict_population",
    with_("patients", "members")
    + """SELECT common_key, age, age_group, sex, nation FROM patients
         WHERE common_key IN (SELECT common_key FROM members)""",
)
def _(spark, sf):
    tables = star_claims(spark, sf)
    return co.restrict_population(tables.patients, claims.members(tables, STAR_SPEC))
