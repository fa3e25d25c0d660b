"""Dashboard datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataspark.operators import cube
from strataspark.operators import dashboard as da
from strataspark.operators.report import chart_series
from strataspark.plans import claims
from strataspark.plans import dashboards as plans
from strataspark.session import scratch_path
from strataspark.sources import codes, star
from strataspark.suite.binding import STAR_SPEC, star_master
from strataspark.suite.registry import ORACLE, query
from strataspark.suite.sql import ordinal, with_

BASE_COLUMNS = """patient_id, sex, age, age_group, prefecture_code, prefecture_name, diagnosis_year, diabetes_diagnosis_date,
  has_hypertension, has_dyslipidemia, has_ckd, comorbidity_pattern, cv_event_occurred, follow_up_months, hba1c, bmi"""


def _base(spark, sf):
    return plans.patient_base(star.chronic_cohort(spark, sf))


@query("dash_base", with_("base") + f"SELECT {BASE_COLUMNS} FROM base")
def _(spark, sf):
    return _base(spark, sf)


@query(
    "dash_filters",
    with_("base")
    + f"""SELECT {BASE_COLUMNS} FROM base WHERE sex = 'F' AND age_group IN ('60-69', '70-79', '80+')
          AND prefecture_name IN ('Tokyo', 'Saitama', 'Other')""",
)
def _(spark, sf):
    return plans.filtered(
        _base(spark, sf),
        sex="F",
        age_group=["60-69", "70-79", "80+"],
        prefecture_name=["Tokyo", "Saitama", "Other"],
        comorbidity_pattern=[],
    )


@query("dash_bar", with_("base") + "SELECT comorbidity_pattern, COUNT(*) AS n FROM base GROUP BY comorbidity_pattern")
def _(spark, sf):
    return da.bar(_base(spark, sf), "comorbidity_pattern")


@query(
    "dash_line",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY 1",
)
def _(spark, sf):
    return da.line(star.read(spark, sf, "orders"), "o_orderdate")


@query(
    "dash_histogram",
    with_("base", "aged_visits")
    + """SELECT 'hba1c' AS measure, floor(hba1c / CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS bin, COUNT(*) AS n FROM base GROUP BY 2
       UNION ALL SELECT 'bmi', floor(bmi / CAST(2 AS DOUBLE)) * CAST(2 AS DOUBLE), COUNT(*) FROM base GROUP BY 2
       UNION ALL SELECT 'age', CAST(age AS DOUBLE), COUNT(*) FROM aged_visits WHERE weight >= 0 GROUP BY 2""",
)
def _(spark, sf):
    base, visits = _base(spark, sf), plans.checkup_base(star.checkups(spark, sf))
    ages = plans.age_histogram(visits).select(F.lit("age").alias("measure"), "bin", "n")
    return da.histograms(base, {"hba1c": 0.5, "bmi": 2}).unionByName(ages)


@query("dash_scatter", with_("aged_visits") + "SELECT weight, height FROM aged_visits")
def _(spark, sf):
    return da.scatter(plans.checkup_base(star.checkups(spark, sf)), "weight", "height")


@query(
    "chart_series",
    with_("master")
    + ", t AS (SELECT age_group, round(avg(MTX) * 100, 1) AS MTX, round(avg(bDMARDs) * 100, 1) AS bDMARDs, "
    + "round(round(avg(TNFI) * 100, 1) / nullif(round(avg(ABT) * 100, 1), 0), 1) AS TNFI_ABT_ratio FROM master GROUP BY age_group) "
    + f"SELECT t.*, m.v AS MTX_paper, b.v AS bDMARDs_paper, {ordinal('t.age_group', codes.AGE_LABELS)} AS sort_key FROM t JOIN (VALUES "
    + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in codes.PUBLISHED_MTX.items())
    + ") m(age_group, v) USING (age_group) JOIN (VALUES "
    + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in codes.PUBLISHED_BIOLOGICS.items())
    + ") b(age_group, v) USING (age_group)",
)
def _(spark, sf):
    usage = claims.medication_usage(star_master(spark, sf), STAR_SPEC)
    published = {k: (v, codes.PUBLISHED_BIOLOGICS[k]) for k, v in codes.PUBLISHED_MTX.items()}
    paper = codes.reference_values(spark, published, "age_group", ["MTX_paper", "bDMARDs_paper"])
    return chart_series(usage, "age_group", ["MTX", "bDMARDs", "TNFI_ABT_ratio"], codes.AGE_LABELS, paper)


_CHOSEN = {"sex": ["F"], "age_group": ["60-69", "70-79", "80+"], "prefecture_name": ["Tokyo", "Saitama", "Other"], "comorbidity_pattern": []}
_CHOSEN_SQL = "sex = 'F' AND age_group IN ('60-69', '70-79', '80+') AND prefecture_name IN ('Tokyo', 'Saitama', 'Other')"


def _cube(spark, sf, widest=None):
    path = scratch_path(spark, "cube")
    base = _base(spark, sf)
    cube.store_cube(base, path, plans.FACETS, {"events": F.col("cv_event_occurred").cast("long")}, widest)
    return path, base


@query("cube_facets", ORACLE["facet_counts"])
def _(spark, sf):
    """The facets from a stored cube of all filter fields."""
    path, base = _cube(spark, sf)
    chosen = {"sex": ["M"], "age_group": ["40-49", "50-59"], "prefecture_name": ["Tokyo", "Other"], "comorbidity_pattern": []}
    return cube.cube_facets(spark, path, plans.FACETS, chosen, base)


@query(
    "cube_bar",
    with_("base")
    + f"SELECT comorbidity_pattern, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CAST(cv_event_occurred AS INTEGER)) AS BIGINT) AS events "
    + f"FROM base WHERE {_CHOSEN_SQL} GROUP BY comorbidity_pattern",
)
def _(spark, sf):
    """Patterns and their events under three filters, from the cube."""
    path, base = _cube(spark, sf)
    return cube.cube_bar(spark, path, "comorbidity_pattern", _CHOSEN, base, {"events": F.col("cv_event_occurred").cast("long")})
