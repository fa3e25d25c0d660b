"""Whole studies, from the tables to their stored or final results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.stats import Z_95
from strataspark.operators.report import long_form
from strataspark.plans import claims, survival_study
from strataspark.session import scratch_path
from strataspark.sources import star, tables
from strataspark.sources.codes import AGE_LABELS, PUBLISHED_SUMMARY
from strataspark.suite.aggregates import EVENTS_SQL, SUMMARY_SQL
from strataspark.suite.binding import STAR_SPEC, star_claims
from strataspark.suite.registry import ORACLE, query
from strataspark.suite.sql import erfc_tail, ordinal, with_
from strataspark.suite.sql import long_form as long_form_sql
from strataspark.suite.survival import CURVE_SQL, RATIO_SQL, SURVIVAL_SQL, events_sql, logrank_sql

_PROC = ["TJR", "BMD", "VISIT", "any_RA_surgery"]
_PROC_PCT = ", ".join(f"round(avg({f}) * 100, 2) AS {f}" for f in _PROC)


@query(
    "claims_study",
    with_("master")
    + f""", rows_ AS (SELECT age_group, COUNT(*) AS n, {_PROC_PCT} FROM master GROUP BY age_group
          UNION ALL SELECT 'Total', COUNT(*), {_PROC_PCT} FROM master)
        SELECT *, {ordinal('age_group', AGE_LABELS)} AS sort_key, (SELECT COUNT(*) FROM master) AS cohort_rows,
          (SELECT COUNT(*) FROM rows_) AS age_rows, (SELECT COUNT(*) FROM rows_) AS medication_rows,
          CAST({len(STAR_SPEC.definitions)} AS BIGINT) AS definition_rows, CAST({len(PUBLISHED_SUMMARY)} AS BIGINT) AS summary_rows
        FROM rows_""",
)
def _(spark, sf):
    """Store all silver and gold tables, then read the procedure table back beside the rows of the others."""
    path = scratch_path(spark, "claims_study")
    written = claims.run(star_claims(spark, sf), STAR_SPEC, path, declared=False)
    sizes = {
        "cohort_rows": "cohort", "age_rows": "age_distribution", "medication_rows": "medication_usage",
        "definition_rows": "definitions_summary", "summary_rows": "summary",
    }
    stored = tables.scan_table(spark, f"{path}/gold/procedure_usage")
    return stored.withColumns({name: F.lit(written[table]).cast("long") for name, table in sizes.items()})


_DRUGS = list(STAR_SPEC.drug_groups)
_FLAGS = [*_DRUGS, *STAR_SPEC.procedure_groups]
# stored table -> (layer, key, SQL of its rows, columns of numbers, columns of text)
STORED = {
    "candidates": (
        "silver", "common_key",
        with_("def0", "months", "drug_flags")
        + "SELECT common_key, COALESCE(prescription_months, 0) AS prescription_months, "
        + ", ".join(f"COALESCE({f}, 0) AS {f}" for f in _DRUGS)
        + " FROM def0 LEFT JOIN months USING (common_key) LEFT JOIN drug_flags USING (common_key)",
        ["prescription_months", *_DRUGS], [],
    ),
    "cohort": (
        "silver", "common_key", ORACLE["cohort_master"],
        ["age", "nation", "prescription_months", *_FLAGS, *STAR_SPEC.composites], ["age_group", "sex"],
    ),
    "definitions_summary": ("silver", "definition", ORACLE["definition_summary"], ["n_patients", "prevalence_pct"], []),
    "age_distribution": (
        "gold", "age_group", ORACLE["stratum_distribution"],
        ["n", "pct_of_total", "female_pct", "fm_ratio", "prevalence", "paper_pct", "paper_prevalence", "sort_key"], [],
    ),
    "medication_usage": (
        "gold", "age_group", ORACLE["ratio_of_rates"], ["n", *_DRUGS, "bDMARDs", "TNFI_ABT_ratio", "sort_key"], [],
    ),
    "procedure_usage": (
        "gold", "age_group",
        with_("master")
        + f""", rows_ AS (SELECT age_group, COUNT(*) AS n, {_PROC_PCT} FROM master GROUP BY age_group
          UNION ALL SELECT 'Total', COUNT(*), {_PROC_PCT} FROM master)
        SELECT *, {ordinal('age_group', AGE_LABELS)} AS sort_key FROM rows_""",
        ["n", *_PROC, "sort_key"], [],
    ),
    "summary": ("gold", "metric", ORACLE["metric_report"], [], ["reproduced", "paper", "note"]),
}


@query(
    "claims_study_tables",
    " UNION ALL ".join(long_form_sql(name, sql, key, numbers, texts) for name, (_, key, sql, numbers, texts) in STORED.items()),
)
def _(spark, sf):
    """Store all silver and gold tables, then read every one of them back, value by value."""
    path = scratch_path(spark, "claims_tables")
    claims.run(star_claims(spark, sf), STAR_SPEC, path, declared=False)
    parts = []
    for name, (layer, key, _, _, _) in STORED.items():
        stored = tables.scan_table(spark, f"{path}/{layer}/{name}")
        if "prevalence_pct" in stored.columns:
            stored = stored.withColumn("prevalence_pct", F.round("prevalence_pct", 8))
        parts.append(long_form(stored, name, key))
    return reduce(DataFrame.unionByName, parts)


_COHORT = ", cohort AS (SELECT *, follow_up_months AS months, CAST(cv_event_occurred AS INTEGER) AS event FROM analysis)"


def _analysis(spark, sf):
    return survival_study.derive_events(
        survival_study.select_cohort(star.chronic_cohort(spark, sf), 40, "1995-12-31")
    )


@query(
    "survival_study_curves",
    with_("analysis")
    + _COHORT
    + f""", {events_sql('cohort', 'has_hypertension')}, {CURVE_SQL}, s AS (SELECT *, {SURVIVAL_SQL} AS sv FROM curve)
        SELECT g AS has_hypertension, t, n AS n_at_risk, d AS n_events, round(sv, 9) AS survival,
          CASE WHEN sv > 0 AND sv < 1 THEN round(exp(-exp(ln(-ln(sv)) - {Z_95} * sqrt(gw) / ln(sv))), 9) END AS ci_lower,
          CASE WHEN sv > 0 AND sv < 1 THEN round(exp(-exp(ln(-ln(sv)) + {Z_95} * sqrt(gw) / ln(sv))), 9) END AS ci_upper FROM s""",
)
def _(spark, sf):
    curves = survival_study.curves_by_hypertension(_analysis(spark, sf))
    return curves.select(
        "has_hypertension", "t", "n_at_risk", "n_events",
        *[F.round(c, 9).alias(c) for c in ("survival", "ci_lower", "ci_upper")],
    )


_AGE_STRATUM = "CASE WHEN age < 70 THEN 'under 70' ELSE '70 and over' END"


@query(
    "survival_study_tests",
    with_("analysis")
    + ", cohort AS (SELECT follow_up_months AS months, CAST(cv_event_occurred AS INTEGER) AS event, has_hypertension, "
    + f"{_AGE_STRATUM} AS stratum FROM analysis), {logrank_sql('cohort', 'has_hypertension', 'FALSE', 'stratum')}, "
    + f"p AS (SELECT *, {erfc_tail('chi2')} AS p FROM test) "
    + "SELECT s AS stratum, o AS observed, round(chi2, 8) AS chi2, round(p, 8) AS p_value FROM p",
)
def _(spark, sf):
    tests = survival_study.test_by_age_stratum(_analysis(spark, sf))
    return tests.select("stratum", "observed", F.round("chi2", 8).alias("chi2"), F.round("p_value", 8).alias("p_value"))


@query(
    "survival_study_bmi",
    with_("analysis")
    + """, filled AS (SELECT COALESCE(bmi, (SELECT median(bmi) FROM analysis)) AS b, cv_event_occurred FROM analysis)
       SELECT CASE WHEN b > 0 AND b <= 18.5 THEN 'Underweight' WHEN b > 18.5 AND b <= 25 THEN 'Normal'
         WHEN b > 25 AND b <= 30 THEN 'Overweight' WHEN b > 30 AND b <= 100 THEN 'Obese' END AS bmi_category,
         COUNT(*) AS n, COUNT(*) FILTER (cv_event_occurred) AS events FROM filled GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "selection")
    cohort = survival_study.analysis_cohort(star.chronic_cohort(spark, sf), 40, "1995-12-31", ["bmi"], path)
    return cohort.groupBy("bmi_category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event") == 1).alias("events"))


_PATTERN_SQL = (
    with_("analysis")
    + _COHORT
    + f""", sizes AS (SELECT comorbidity_pattern, COUNT(*) AS n, CAST(SUM(event) AS BIGINT) AS events FROM cohort GROUP BY 1
        ORDER BY n DESC, comorbidity_pattern LIMIT 5),
      kept AS (SELECT * FROM cohort WHERE comorbidity_pattern IN (SELECT comorbidity_pattern FROM sizes)),
      {events_sql('kept', 'comorbidity_pattern')}, {CURVE_SQL}
      SELECT g AS comorbidity_pattern, t, curve.n AS n_at_risk, d AS n_events, c AS n_censored,
        round({SURVIVAL_SQL}, 9) AS survival, sizes.n, sizes.events FROM curve JOIN sizes ON g = comorbidity_pattern"""
)
_OVERALL_SQL = (
    with_("analysis")
    + _COHORT
    + f""", {logrank_sql('cohort', 'has_hypertension', 'FALSE', "'all'")}, p AS (SELECT *, {erfc_tail('chi2')} AS p FROM test)
      SELECT o AS observed, round(e, 8) AS expected, round(v, 8) AS variance, round(chi2, 8) AS chi2, round(p, 8) AS p_value,
        CASE WHEN p < 0.001 THEN 'p<0.001' WHEN p < 0.05 THEN 'p<0.05' ELSE 'p>=0.05' END AS verdict FROM p"""
)


def _keyed(*columns: str) -> str:
    return " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)


# stored table -> (columns that make the key, SQL of its rows, columns of numbers, columns of text)
SURVIVAL_STORED = {
    "attrition": (["criterion"], ORACLE["attrition_cascade"], ["step", "n_remaining"], []),
    "cohort": (
        ["patient_id"],
        with_("analysis")
        + """, m AS (SELECT median(bmi) AS bmi, median(hba1c) AS hba1c FROM analysis), filled AS (
            SELECT a.*, COALESCE(a.bmi, m.bmi) AS bmi_imputed, COALESCE(a.hba1c, m.hba1c) AS hba1c_imputed FROM analysis a, m)
          SELECT patient_id, age, follow_up_months, CAST(cv_event_occurred AS INTEGER) AS event, round(bmi_imputed, 9) AS bmi_imputed,
            round(hba1c_imputed, 9) AS hba1c_imputed, sex, comorbidity_pattern,
            CASE WHEN bmi_imputed > 0 AND bmi_imputed <= 18.5 THEN 'Underweight' WHEN bmi_imputed > 18.5 AND bmi_imputed <= 25 THEN 'Normal'
              WHEN bmi_imputed > 25 AND bmi_imputed <= 30 THEN 'Overweight' WHEN bmi_imputed > 30 AND bmi_imputed <= 100 THEN 'Obese' END AS bmi_category
          FROM filled""",
        ["age", "follow_up_months", "event", "bmi_imputed", "hba1c_imputed"], ["sex", "comorbidity_pattern", "bmi_category"],
    ),
    "summary": (
        [], with_("analysis") + SUMMARY_SQL + "analysis",
        ["n", "min_months", "max_months", "median_months", "events", "event_pct", "hypertension_count", "dyslipidemia_count", "ckd_count",
         "hypertension_pct", "dyslipidemia_pct", "ckd_pct", "mean_age", "male_pct"], [],
    ),
    "events_by_pattern": (
        ["comorbidity_pattern"], with_("analysis") + EVENTS_SQL.format(source="analysis"), ["n", "events", "event_rate", "event_rate_pct"], [],
    ),
    "curves_by_hypertension": (
        ["has_hypertension", "t"], ORACLE["survival_study_curves"], ["n_at_risk", "n_events", "survival", "ci_lower", "ci_upper"], [],
    ),
    "curves_by_pattern": (
        ["comorbidity_pattern", "t"], _PATTERN_SQL, ["n_at_risk", "n_events", "n_censored", "survival", "n", "events"], [],
    ),
    "test_by_hypertension": ([], _OVERALL_SQL, ["observed", "expected", "variance", "chi2", "p_value"], ["verdict"]),
    "tests_by_age": (["stratum"], ORACLE["survival_study_tests"], ["observed", "chi2", "p_value"], []),
    "rate_ratio": ([], with_("analysis") + RATIO_SQL.format(source="analysis"), ["rate_unexposed", "rate_exposed", "rate_ratio"], []),
}
_ROUNDED = {"survival": 9, "ci_lower": 9, "ci_upper": 9, "bmi_imputed": 9, "hba1c_imputed": 9, "expected": 8, "variance": 8, "chi2": 8, "p_value": 8}


@query(
    "survival_study_tables",
    " UNION ALL ".join(
        long_form_sql(name, sql, _keyed(*keys) if keys else "'all'", numbers, texts) for name, (keys, sql, numbers, texts) in SURVIVAL_STORED.items()
    ),
)
def _(spark, sf):
    """Store the cohort and every result of the survival study, then read them all back, value by value."""
    path = scratch_path(spark, "survival_tables")
    survival_study.run(star.chronic_cohort(spark, sf), path, 40, "1995-12-31")
    parts = []
    for name, (keys, _, numbers, texts) in SURVIVAL_STORED.items():
        stored = tables.scan_table(spark, f"{path}/{name}")
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
        values = [F.round(c, _ROUNDED[c]).alias(c) if c in _ROUNDED else F.col(c) for c in (*numbers, *texts)]
        parts.append(long_form(stored.select(key.alias("row_key"), *values), name, "row_key"))
    return reduce(DataFrame.unionByName, parts)
