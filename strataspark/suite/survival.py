"""Survival analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.functions.stats import Z_95
from strataspark.operators import survival as su
from strataspark.sources import star
from strataspark.suite.registry import query
from strataspark.suite.sql import erfc_tail, with_


def events_sql(source: str, by: str) -> str:
    """Event table with an origin row per group, as CTEs ``per_time``, ``risk`` and ``ev``."""
    return f"""per_time AS (SELECT {by} AS g, months AS t, COUNT(*) AS leaving, SUM(event) AS d FROM {source} GROUP BY 1, 2),
      risk AS (SELECT g, t, CAST(SUM(leaving) OVER (PARTITION BY g ORDER BY t DESC) AS BIGINT) AS n,
                      CAST(d AS BIGINT) AS d, CAST(leaving - d AS BIGINT) AS c FROM per_time),
      ev AS (SELECT * FROM risk UNION ALL
             SELECT g, 0, MAX(n), 0, 0 FROM risk GROUP BY g HAVING MIN(t) > 0)"""


CURVE_SQL = """curve AS (SELECT g, t, n, d, c,
    SUM(CASE WHEN n > d THEN ln(1 - CAST(d AS DOUBLE) / n) ELSE 0 END) OVER w AS logs,
    SUM(CASE WHEN n > d THEN CAST(d AS DOUBLE) / (CAST(n AS DOUBLE) * (n - d)) ELSE 0 END) OVER w AS gw,
    MAX(CASE WHEN n = d THEN 1 ELSE 0 END) OVER w AS ended FROM ev WINDOW w AS (PARTITION BY g ORDER BY t))"""
SURVIVAL_SQL = "CASE WHEN ended = 1 THEN 0 ELSE exp(logs) END"


@query(
    "event_table",
    with_("survival") + f", {events_sql('survival', 'grp')} SELECT g AS grp, t, n AS n_at_risk, d AS n_events, c AS n_censored FROM risk",
)
def _(spark, sf):
    return su.event_table(star.survival_input(spark, sf), "months", "event", ["grp"])


@query(
    "kaplan_meier",
    with_("survival")
    + f""", {events_sql('survival', 'grp')}, {CURVE_SQL}
        SELECT g AS grp, t, n AS n_at_risk, d AS n_events, c AS n_censored, round({SURVIVAL_SQL}, 10) AS survival FROM curve""",
)
def _(spark, sf):
    curve = su.kaplan_meier(star.survival_input(spark, sf), "months", "event", ["grp"])
    return curve.drop("greenwood").withColumn("survival", F.round("survival", 10))


@query(
    "km_confidence",
    with_("survival")
    + f""", {events_sql('survival', 'grp')}, {CURVE_SQL}, s AS (SELECT *, {SURVIVAL_SQL} AS sv FROM curve)
        SELECT g AS grp, t, round(sv, 9) AS survival,
          CASE WHEN sv > 0 AND sv < 1 THEN round(exp(-exp(ln(-ln(sv)) - {Z_95} * sqrt(gw) / ln(sv))), 9) END AS ci_lower,
          CASE WHEN sv > 0 AND sv < 1 THEN round(exp(-exp(ln(-ln(sv)) + {Z_95} * sqrt(gw) / ln(sv))), 9) END AS ci_upper FROM s""",
)
def _(spark, sf):
    band = su.km_confidence(su.kaplan_meier(star.survival_input(spark, sf), "months", "event", ["grp"]))
    return band.select("grp", "t", *[F.round(c, 9).alias(c) for c in ("survival", "ci_lower", "ci_upper")])


def logrank_sql(source: str, group: str, first: str, by: str) -> str:
    """Log-rank sums per stratum, with risk sets counted person by person (small inputs)."""
    return f"""tm AS (SELECT DISTINCT {by} AS s, months AS t FROM {source}),
      sets AS (SELECT s, t,
          COUNT(*) AS n, COUNT(*) FILTER ({group} = {first}) AS n1,
          COUNT(*) FILTER (months = t AND event = 1) AS d,
          COUNT(*) FILTER (months = t AND event = 1 AND {group} = {first}) AS d1
        FROM tm JOIN {source} ON {by} = s AND months >= t GROUP BY s, t),
      lr AS (SELECT s, CAST(SUM(d1) AS BIGINT) AS o, SUM(d * CAST(n1 AS DOUBLE) / n) AS e,
          SUM(d * (CAST(n1 AS DOUBLE) / n) * (1 - CAST(n1 AS DOUBLE) / n)
              * CASE WHEN n > 1 THEN CAST(n - d AS DOUBLE) / (n - 1) ELSE 0 END) AS v FROM sets GROUP BY s),
      test AS (SELECT *, (o - e) * (o - e) / v AS chi2 FROM lr)"""


@query(
    "logrank_test",
    with_("survival")
    + f""", {logrank_sql('survival', 'grp', '0', "'all'")} SELECT o AS observed, round(e, 8) AS expected,
        round(v, 8) AS variance, round(chi2, 8) AS chi2 FROM test""",
)
def _(spark, sf):
    test = su.logrank_test(star.survival_input(spark, sf), "months", "event", "grp", 0, 1)
    return test.select("observed", *[F.round(c, 8).alias(c) for c in ("expected", "variance", "chi2")])


@query(
    "logrank_pvalue",
    with_("survival")
    + f""", {logrank_sql('survival', 'grp', '0', "'all'")}, p AS (SELECT chi2, {erfc_tail('chi2')} AS p FROM test)
        SELECT round(chi2, 8) AS chi2, round(p, 8) AS p_value,
          CASE WHEN p < 0.001 THEN 'p<0.001' WHEN p < 0.05 THEN 'p<0.05' ELSE 'p>=0.05' END AS verdict FROM p""",
)
def _(spark, sf):
    test = su.logrank_pvalue(su.logrank_test(star.survival_input(spark, sf), "months", "event", "grp", 0, 1))
    return test.select(F.round("chi2", 8).alias("chi2"), F.round("p_value", 8).alias("p_value"), "verdict")


@query(
    "km_by_pattern",
    with_("chronic")
    + f""", cohort AS (SELECT comorbidity_pattern, follow_up_months AS months, CAST(cv_event_occurred AS INTEGER) AS event FROM chronic),
      sizes AS (SELECT comorbidity_pattern, COUNT(*) AS n, CAST(SUM(event) AS BIGINT) AS events FROM cohort GROUP BY 1
        ORDER BY n DESC, comorbidity_pattern LIMIT 5),
      kept AS (SELECT * FROM cohort WHERE comorbidity_pattern IN (SELECT comorbidity_pattern FROM sizes)),
      {events_sql('kept', 'comorbidity_pattern')}, {CURVE_SQL}
      SELECT g AS comorbidity_pattern, t, curve.n AS n_at_risk, d AS n_events, c AS n_censored,
        round({SURVIVAL_SQL}, 10) AS survival, sizes.n, sizes.events FROM curve JOIN sizes ON g = comorbidity_pattern""",
)
def _(spark, sf):
    cohort = star.chronic_cohort(spark, sf).select(
        "comorbidity_pattern", "follow_up_months", F.col("cv_event_occurred").cast("int").alias("event")
    )
    curves = su.km_by_pattern(cohort, "follow_up_months", "event", "comorbidity_pattern", 5)
    return curves.withColumn("survival", F.round("survival", 10))


@query(
    "subgroup_logrank",
    with_("survival")
    + f""", {logrank_sql('survival', 'grp', '0', 'stratum')}, p AS (SELECT *, {erfc_tail('chi2')} AS p FROM test)
        SELECT s AS stratum, o AS observed, round(e, 8) AS expected, round(v, 8) AS variance, round(chi2, 8) AS chi2,
          round(p, 8) AS p_value,
          CASE WHEN p < 0.001 THEN 'p<0.001' WHEN p < 0.05 THEN 'p<0.05' ELSE 'p>=0.05' END AS verdict FROM p""",
)
def _(spark, sf):
    test = su.subgroup_logrank(star.survival_input(spark, sf), "months", "event", "grp", 0, 1, "stratum")
    return test.select(
        "stratum", "observed", *[F.round(c, 8).alias(c) for c in ("expected", "variance", "chi2", "p_value")], "verdict"
    )


RATIO_SQL = """, r AS (SELECT avg(CAST(cv_event_occurred AS INTEGER)) FILTER (NOT has_hypertension) AS u,
           avg(CAST(cv_event_occurred AS INTEGER)) FILTER (has_hypertension) AS e FROM {source})
       SELECT round(u * 100, 2) AS rate_unexposed, round(e * 100, 2) AS rate_exposed, round(e / nullif(u, 0), 2) AS rate_ratio
       FROM r"""


@query("event_rate_ratio", with_("chronic") + RATIO_SQL.format(source="chronic"))
def _(spark, sf):
    cohort = star.chronic_cohort(spark, sf).withColumn("event", F.col("cv_event_occurred").cast("int"))
    return su.event_rate_ratio(cohort, F.col("has_hypertension"), "event")
