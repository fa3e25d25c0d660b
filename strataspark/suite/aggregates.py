"""Counts, rates, distributions and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.operators import cohort as co
from strataspark.operators import profile as pr
from strataspark.operators import rates as ra
from strataspark.operators.dashboard import facet_counts, histogram
from strataspark.operators.quantiles import medians
from strataspark.plans import claims, dashboards, survival_study
from strataspark.sources import codes, star
from strataspark.suite.binding import STAR_SPEC, star_claims, star_master
from strataspark.suite.registry import query
from strataspark.suite.sql import ordinal, with_

FLAG_NAMES = ["MTX", "SSZ", "TNFI", "IL6I", "ABT", "CS", "LEF"]


@query(
    "count_rows",
    """SELECT COUNT(*) AS n, COUNT(*) FILTER (o_totalprice >= 300000) AS n_high,
              COUNT(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent FROM orders""",
)
def _(spark, sf):
    return star.read(spark, sf, "orders").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_totalprice") >= 300000).alias("n_high"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
    )


@query(
    "group_count",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2",
)
def _(spark, sf):
    by = ["l_returnflag", "l_linestatus"]
    return ra.group_count(star.read(spark, sf, "lineitem"), by).orderBy(*by)


@query(
    "profile_overview",
    with_("chronic")
    + """SELECT COUNT(*) AS total, MIN(diabetes_diagnosis_date) AS earliest, MAX(diabetes_diagnosis_date) AS latest,
         COUNT(DISTINCT prefecture_code) AS n_categories FROM chronic""",
)
def _(spark, sf):
    return pr.profile_overview(star.chronic_cohort(spark, sf), "diabetes_diagnosis_date", "prefecture_code")


@query("exposure_months", with_("months") + "SELECT * FROM months")
def _(spark, sf):
    return co.exposure_months(star.medication_lines(spark, sf), star.receipts(spark, sf), star.EXPOSURE_TYPES)


@query(
    "distribution_stats",
    with_("months")
    + """SELECT COUNT(*) AS n, round(avg(prescription_months), 1) AS mean, MIN(prescription_months) AS min,
         MAX(prescription_months) AS max, quantile_disc(prescription_months, 0.25) AS q25,
         quantile_disc(prescription_months, 0.5) AS median, quantile_disc(prescription_months, 0.75) AS q75 FROM months""",
)
def _(spark, sf):
    months = co.exposure_months(star.medication_lines(spark, sf), star.receipts(spark, sf), star.EXPOSURE_TYPES)
    return pr.distribution_stats(months, "prescription_months")


@query(
    "describe_column",
    """SELECT COUNT(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS stddev,
         MIN(o_totalprice) AS min, MAX(o_totalprice) AS max FROM orders""",
)
def _(spark, sf):
    return pr.describe_column(star.read(spark, sf, "orders"), "o_totalprice", 4)


@query(
    "conditional_sums",
    with_("patients")
    + """SELECT COUNT(*) AS n, COUNT(*) FILTER (sex = '2') AS female_count,
         COUNT(*) FILTER (age >= 65) AS elderly_65_count, COUNT(*) FILTER (age >= 85) AS elderly_85_count,
         round(COUNT(*) FILTER (sex = '2') * CAST(100 AS DOUBLE) / COUNT(*), 1) AS female_pct,
         round(COUNT(*) FILTER (age >= 65) * CAST(100 AS DOUBLE) / COUNT(*), 1) AS elderly_65_pct,
         round(COUNT(*) FILTER (age >= 85) * CAST(100 AS DOUBLE) / COUNT(*), 1) AS elderly_85_pct FROM patients""",
)
def _(spark, sf):
    tests = {
        "female": F.col("sex") == "2",
        "elderly_65": F.col("age") >= 65,
        "elderly_85": F.col("age") >= 85,
    }
    return ra.conditional_sums(star.patients(spark, sf), tests)


@query("flag_pivot", with_("drug_flags") + "SELECT * FROM drug_flags")
def _(spark, sf):
    facts = star.medication_lines(spark, sf)
    return co.flag_pivot(facts, star.TYPE_GROUPS, claims=star.receipts(spark, sf))


@query(
    "stratified_rates",
    with_("patients", "drug_flags")
    + "SELECT age_group, COUNT(*) AS n, "
    + ", ".join(f"round(avg({f}) * 100, 2) AS {f}" for f in FLAG_NAMES)
    + " FROM patients JOIN drug_flags USING (common_key) GROUP BY age_group",
)
def _(spark, sf):
    facts = star.medication_lines(spark, sf)
    flags = co.flag_pivot(facts, star.TYPE_GROUPS, claims=star.receipts(spark, sf))
    wide = star.patients(spark, sf).join(flags, "common_key")
    return ra.stratified_rates(wide, "age_group", FLAG_NAMES)


_TOTALS = ", ".join(f"round(avg({f}) * 100, 2) AS {f}" for f in FLAG_NAMES)


@query(
    "with_total_row",
    with_("patients", "drug_flags")
    + ", joined AS (SELECT * FROM patients JOIN drug_flags USING (common_key)), rows_ AS ("
    + f"SELECT age_group, COUNT(*) AS n, {_TOTALS} FROM joined GROUP BY age_group "
    + f"UNION ALL SELECT 'Total', COUNT(*), {_TOTALS} FROM joined) "
    + f"SELECT *, {ordinal('age_group', codes.AGE_LABELS)} AS sort_key FROM rows_",
)
def _(spark, sf):
    facts = star.medication_lines(spark, sf)
    flags = co.flag_pivot(facts, star.TYPE_GROUPS, claims=star.receipts(spark, sf))
    wide = star.patients(spark, sf).join(flags, "common_key")
    return ra.rates_with_total(wide, "age_group", FLAG_NAMES, codes.AGE_LABELS)


@query(
    "overall_rates",
    with_("master")
    + "SELECT "
    + ", ".join(f"round(avg({f}) * 100, 1) AS {f}_pct" for f in [*FLAG_NAMES, "bDMARDs", "any_DMARD"])
    + " FROM master",
)
def _(spark, sf):
    return ra.overall_rates(star_master(spark, sf), [*FLAG_NAMES, "bDMARDs", "any_DMARD"])


_DISTRIBUTION = """COUNT(*) AS n,
  round(COUNT(*) * CAST(100 AS DOUBLE) / (SELECT COUNT(*) FROM master), 1) AS pct_of_total,
  round(COUNT(*) FILTER (sex = '2') * CAST(100 AS DOUBLE) / COUNT(*), 1) AS female_pct,
  round(COUNT(*) FILTER (sex = '2') / CAST(nullif(COUNT(*) FILTER (sex = '1'), 0) AS DOUBLE), 2) AS fm_ratio"""


@query(
    "stratum_distribution",
    with_("master")
    + f""", pop AS (SELECT age_group, COUNT(*) AS n_pop FROM patients GROUP BY age_group),
        rows_ AS (SELECT m.age_group, {_DISTRIBUTION},
            round(COUNT(*) * CAST(100 AS DOUBLE) / MAX(n_pop), 2) AS prevalence
          FROM master m LEFT JOIN pop USING (age_group) GROUP BY m.age_group
          UNION ALL SELECT 'Total', {_DISTRIBUTION},
            round(COUNT(*) * CAST(100 AS DOUBLE) / (SELECT COUNT(*) FROM patients), 2) FROM master)
        SELECT r.*, p.pct AS paper_pct, p.prev AS paper_prevalence,
          {ordinal('r.age_group', codes.AGE_LABELS)} AS sort_key FROM rows_ r LEFT JOIN (VALUES """
    + ", ".join(f"('{k}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for k, (a, b) in codes.PUBLISHED_AGE_TABLE.items())
    + ") p(age_group, pct, prev) USING (age_group)",
)
def _(spark, sf):
    # Only attributes are needed: members joined with persons, no flags.
    tables = star_claims(spark, sf)
    cohort = claims.members(tables, STAR_SPEC).join(tables.patients, "common_key")
    published = codes.reference_values(spark, codes.PUBLISHED_AGE_TABLE, "age_group", ["paper_pct", "paper_prevalence"])
    return claims.age_distribution(cohort, tables.patients, STAR_SPEC, published)


_MED = [*FLAG_NAMES, "bDMARDs"]
_MED_PCT = ", ".join(f"round(avg({f}) * 100, 1) AS {f}" for f in _MED)


@query(
    "ratio_of_rates",
    with_("master")
    + f""", strata AS (SELECT age_group, COUNT(*) AS n, {_MED_PCT} FROM master GROUP BY age_group),
        rows_ AS (SELECT *, round(TNFI / nullif(ABT, 0), 1) AS TNFI_ABT_ratio FROM strata
          UNION ALL SELECT 'Total', COUNT(*), {_MED_PCT}, round(avg(TNFI) / nullif(avg(ABT), 0), 1) FROM master)
        SELECT *, {ordinal('age_group', codes.AGE_LABELS)} AS sort_key FROM rows_""",
)
def _(spark, sf):
    return claims.medication_usage(star_master(spark, sf), STAR_SPEC)


EVENTS_SQL = """SELECT comorbidity_pattern, COUNT(*) AS n, COUNT(*) FILTER (cv_event_occurred) AS events,
         CAST(round_even(avg(CAST(cv_event_occurred AS INTEGER)), 4) AS DOUBLE) AS event_rate,
         CAST(round_even(round_even(avg(CAST(cv_event_occurred AS INTEGER)), 4) * 100, 2) AS DOUBLE) AS event_rate_pct
         FROM {source} GROUP BY comorbidity_pattern"""


@query("grouped_events", with_("chronic") + EVENTS_SQL.format(source="chronic"))
def _(spark, sf):
    return survival_study.events_by_pattern(survival_study_input(spark, sf))


def survival_study_input(spark, sf):
    return star.chronic_cohort(spark, sf).withColumn("event", F.col("cv_event_occurred").cast("int"))


@query("distinct_keys", with_("disease") + "SELECT DISTINCT common_key FROM disease")
def _(spark, sf):
    return co.distinct_keys(co.claims_with(star.disease_lines(spark, sf), star.receipts(spark, sf)))


@query(
    "exact_median",
    """SELECT 'o_totalprice' AS column_name, round(median(o_totalprice), 6) AS median FROM orders
       UNION ALL SELECT 'o_orderkey', round(median(o_orderkey), 6) FROM orders""",
)
def _(spark, sf):
    found = medians(star.read(spark, sf, "orders"), ["o_totalprice", "o_orderkey"])
    return found.select("column_name", F.round("median", 6).alias("median"))


@query(
    "missing_profile",
    with_("chronic")
    + """, counts AS (SELECT 'prefecture_code' AS column_name, COUNT(*) - COUNT(prefecture_code) AS missing_count FROM chronic
         UNION ALL SELECT 'hba1c', COUNT(*) - COUNT(hba1c) FROM chronic
         UNION ALL SELECT 'bmi', COUNT(*) - COUNT(bmi) FROM chronic
         UNION ALL SELECT 'age', COUNT(*) - COUNT(age) FROM chronic),
       pct AS (SELECT *, CAST(round_even(missing_count * CAST(100 AS DOUBLE) / (SELECT COUNT(*) FROM chronic), 2) AS DOUBLE)
           AS missing_pct FROM counts)
       SELECT *, CASE WHEN (SELECT MAX(missing_pct) FROM pct) < 10 THEN 'impute' ELSE 'review' END AS verdict
       FROM pct WHERE missing_count > 0""",
)
def _(spark, sf):
    return pr.missing_profile(star.chronic_cohort(spark, sf))


@query(
    "histogram",
    """SELECT floor(value / CAST(10 AS DOUBLE)) * CAST(10 AS DOUBLE) AS bin, COUNT(*) AS n FROM events GROUP BY 1""",
)
def _(spark, sf):
    return histogram(star.read(spark, sf, "events"), "value", 10)


def _facet_sql(field: str, test: str) -> str:
    return f"SELECT '{field}' AS facet, CAST({field} AS VARCHAR) AS value, COUNT(*) FILTER ({test}) AS n_matching FROM base GROUP BY {field}"


_AGE_TEST = "age_group IN ('40-49', '50-59')"
_SEX_TEST = "sex = 'M'"
_NAME_TEST = "prefecture_name IN ('Tokyo', 'Other')"


@query(
    "facet_counts",
    with_("base")
    + " UNION ALL ".join(
        [
            _facet_sql("sex", f"{_AGE_TEST} AND {_NAME_TEST}"),
            _facet_sql("age_group", f"{_SEX_TEST} AND {_NAME_TEST}"),
            _facet_sql("prefecture_name", f"{_SEX_TEST} AND {_AGE_TEST}"),
            _facet_sql("comorbidity_pattern", f"{_SEX_TEST} AND {_AGE_TEST} AND {_NAME_TEST}"),
        ]
    ),
)
def _(spark, sf):
    base = dashboards.patient_base(star.chronic_cohort(spark, sf))
    chosen = {"sex": ["M"], "age_group": ["40-49", "50-59"], "prefecture_name": ["Tokyo", "Other"], "comorbidity_pattern": []}
    return facet_counts(base, dashboards.FACETS, chosen)


@query(
    "definition_summary",
    with_("def0", "months", "patients")
    + """, held AS (SELECT COALESCE(prescription_months, 0) AS m FROM def0 LEFT JOIN months USING (common_key))
       SELECT d.definition, COUNT(*) FILTER (m >= t) AS n_patients,
         round(COUNT(*) FILTER (m >= t) * CAST(100 AS DOUBLE) / (SELECT COUNT(*) FROM patients), 8) AS prevalence_pct
       FROM held, (VALUES ('def_0', 0), ('def_2', 1), ('def_3', 2), ('def_4', 6)) d(definition, t) GROUP BY d.definition""",
)
def _(spark, sf):
    found = claims.definitions(star_claims(spark, sf), STAR_SPEC)
    return found.withColumn("prevalence_pct", F.round("prevalence_pct", 8))


@query(
    "metric_report",
    with_("master")
    + """SELECT m.metric, m.reproduced, p.paper, m.note FROM (
         SELECT 'Total RA Patients (Definition 3)' AS metric, format('{:,}', COUNT(*)) AS reproduced,
           'members of the main definition' AS note FROM master
         UNION ALL SELECT 'Prevalence (%)', printf('%.2f', COUNT(*) * CAST(100 AS DOUBLE) / (SELECT COUNT(*) FROM patients)),
           'members per person' FROM master
         UNION ALL SELECT 'Female Ratio (%)', printf('%.1f', avg(CAST(sex = '2' AS INTEGER)) * 100), 'women' FROM master
         UNION ALL SELECT 'Age >= 65 years (%)', printf('%.1f', avg(CAST(age >= 65 AS INTEGER)) * 100), '65 and over' FROM master
         UNION ALL SELECT 'Age >= 85 years (%)', printf('%.1f', avg(CAST(age >= 85 AS INTEGER)) * 100), '85 and over' FROM master
         UNION ALL SELECT 'MTX Usage (%)', printf('%.1f', avg(MTX) * 100), 'methotrexate' FROM master
         UNION ALL SELECT 'bDMARDs Usage (%)', printf('%.1f', avg(bDMARDs) * 100), 'biologics' FROM master
         UNION ALL SELECT 'Corticosteroid Usage (%)', printf('%.1f', avg(CS) * 100), 'steroids' FROM master
         UNION ALL SELECT 'RA Surgery Rate (%)', printf('%.2f', avg(any_RA_surgery) * 100), 'joint surgery' FROM master) m
       JOIN (VALUES """
    + ", ".join(f"('{k}', '{v}')" for k, v in codes.PUBLISHED_SUMMARY.items())
    + ") p(metric, paper) USING (metric)",
)
def _(spark, sf):
    return claims.summary(star_master(spark, sf), star.patients(spark, sf))


@query(
    "value_counts",
    with_("chronic")
    + """SELECT prefecture_code, COUNT(*) AS n FROM chronic WHERE prefecture_code IS NOT NULL GROUP BY prefecture_code""",
)
def _(spark, sf):
    return pr.value_counts(star.chronic_cohort(spark, sf), "prefecture_code")


SUMMARY_SQL = """SELECT COUNT(*) AS n, MIN(follow_up_months) AS min_months, MAX(follow_up_months) AS max_months,
         CAST(median(follow_up_months) AS DOUBLE) AS median_months, COUNT(*) FILTER (cv_event_occurred) AS events,
         round(avg(CAST(cv_event_occurred AS INTEGER)) * 100, 2) AS event_pct,
         COUNT(*) FILTER (has_hypertension) AS hypertension_count, COUNT(*) FILTER (has_dyslipidemia) AS dyslipidemia_count,
         COUNT(*) FILTER (has_ckd) AS ckd_count, round(avg(CAST(has_hypertension AS INTEGER)) * 100, 1) AS hypertension_pct,
         round(avg(CAST(has_dyslipidemia AS INTEGER)) * 100, 1) AS dyslipidemia_pct,
         round(avg(CAST(has_ckd AS INTEGER)) * 100, 1) AS ckd_pct, round(avg(age), 1) AS mean_age,
         round(avg(CAST(sex = 'M' AS INTEGER)) * 100, 1) AS male_pct FROM """


@query("cohort_summary", with_("chronic") + SUMMARY_SQL + "chronic")
def _(spark, sf):
    return survival_study.summary(star.chronic_cohort(spark, sf))
