from pyspark.sql import functions as F

from strataspark.plans import dashboards, survival_study
from strataspark.sources import star
from strataspark.sources.tables import scan_table


def test_study_runs_from_selection_to_test(spark, sf):
    everybody = star.chronic_cohort(spark, sf)
    steps = [r["n_remaining"] for r in survival_study.attrition(everybody, 40, "1995-12-31").orderBy("step").collect()]
    assert steps == sorted(steps, reverse=True) and steps[0] == 150
    cohort = survival_study.analysis_cohort(everybody, 40, "1995-12-31")
    assert cohort.count() == steps[-1]
    assert cohort.filter(F.col("bmi_imputed").isNull() | F.col("hba1c_imputed").isNull()).count() == 0
    assert survival_study.summary(cohort).first()["n"] == steps[-1]
    curves = survival_study.curves_by_hypertension(cohort).collect()
    assert all(0 <= r["survival"] <= 1 for r in curves)
    test = survival_study.test_by_hypertension(cohort).first()
    assert 0 <= test["p_value"] <= 1
    assert survival_study.test_by_age_stratum(cohort).count() == 2
    assert survival_study.curves_by_pattern(cohort, 3).select("comorbidity_pattern").distinct().count() == 3
    assert survival_study.events_by_pattern(cohort).agg(F.sum("n")).first()[0] == steps[-1]
    assert survival_study.rate_ratio(cohort).first()["rate_ratio"] > 0


def test_stored_run_holds_every_result(spark, sf, tmp_path):
    everybody = star.chronic_cohort(spark, sf)
    for _ in range(2):  # a second run replaces the first
        written = survival_study.run(everybody, str(tmp_path), 40, "1995-12-31", k=3)
    assert set(written) == {
        "attrition", "cohort", "summary", "events_by_pattern", "curves_by_hypertension", "curves_by_pattern", "test_by_hypertension", "tests_by_age", "rate_ratio",
    }
    read = {n: scan_table(spark, f"{tmp_path}/{n}") for n in written}
    assert all(df.count() == written[n] for n, df in read.items())
    cohort = read["cohort"]
    assert read["summary"].first()["n"] == written["cohort"] == read["attrition"].agg(F.min("n_remaining")).first()[0]
    assert read["events_by_pattern"].agg(F.sum("events")).first()[0] == cohort.agg(F.sum("event")).first()[0]
    assert read["curves_by_pattern"].select("comorbidity_pattern").distinct().count() == 3
    assert read["test_by_hypertension"].first() == survival_study.test_by_hypertension(cohort).first()


def test_dashboard_filters_agree_with_facets(spark, sf):
    base = dashboards.patient_base(star.chronic_cohort(spark, sf))
    chosen = {"sex": ["M"], "age_group": ["40-49", "50-59"], "prefecture_name": [], "comorbidity_pattern": []}
    facets = dashboards.facets(base, chosen).filter("facet = 'sex' AND value = 'M'").first()
    assert facets["n_matching"] == dashboards.filtered(base, "M", age_group=["40-49", "50-59"]).count()


def test_checkup_dashboard_on_source_names(spark):
    data = [("2020-06-02", "1980-06-02", 60.0, 170.0), (None, "1980-06-02", 61.0, 171.0), ("2020-06-02", "1990-06-02", None, 172.0)]
    df = spark.createDataFrame(data, "`健診年月日to` string, `生年月日to` string, `体重9n006` double, `身長9n001` double")
    df = df.withColumns({c: F.to_date(F.col(c)) for c in df.columns[:2]})
    visits = dashboards.checkup_base(df)
    assert sorted(r["age"] for r in visits.collect()) == [30, 40]
    # a missing weight does not pass the "at least 0" filter
    assert [tuple(r) for r in dashboards.age_histogram(visits).collect()] == [(40.0, 1)]
