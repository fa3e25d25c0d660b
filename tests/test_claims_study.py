"""The claims study on hand-made tables with real codes, through all stored layers."""

import pytest
from pyspark.sql import functions as F

from strataspark.plans import claims
from strataspark.sources import schemas
from strataspark.sources.tables import scan_table

# person: age, sex, is diagnosed, months of MTX, other codes, procedures
PEOPLE = {
    "p1": (18, "2", True, 3, ["4400101"], ["TJR"]),
    "p2": (45, "2", True, 2, ["2454001"], []),
    "p3": (45, "1", True, 1, [], ["BMD"]),
    "p4": (86, "1", True, 7, ["4400301"], ["ULTRASOUND", "VISIT"]),
    "p5": (70, "2", False, 5, [], []),
    "p6": (None, "1", True, 2, [], []),
    "p7": (60, "2", True, 0, ["4400401"], []),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    persons, receipts, disease, medication, procedure = [], [], [], [], []
    for i, (key, (age, sex, diagnosed, months, drugs, procedures)) in enumerate(PEOPLE.items()):
        persons.append((i, key, age, None, sex, "1970-01-01", True))
        for m in range(1, max(months, 1) + 1):
            receipt = f"{key}-{m}"
            receipts.append((key, receipt, f"2017{m:02d}"))
            if months:
                medication += [(key, receipt, "1199101", "csDMARD", "MTX")] * 2  # repeats within a month count once
        first = f"{key}-1"
        medication += [(key, first, d, "other", "other") for d in drugs]
        procedure += [(key, first, p) for p in procedures]
        disease.append((key, first, "M069" if diagnosed else "M061", "201701"))
        disease.append((key, first, "J00", "201701"))
    root = tmp_path_factory.mktemp("bronze")
    frames = {
        "patients": spark.createDataFrame(persons, schemas.BRONZE["patients"]),
        "re_receipt": spark.createDataFrame(receipts, "common_key string, receipt_id string, service_month string"),
        "sy_disease": spark.createDataFrame(disease, schemas.BRONZE["sy_disease"]),
        "iy_medication": spark.createDataFrame(medication, schemas.BRONZE["iy_medication"]),
        "si_procedure": spark.createDataFrame(procedure, schemas.BRONZE["si_procedure"]),
    }
    paths = {}
    for name, df in frames.items():
        paths[name] = str(root / name)
        df.write.parquet(paths[name])
    return claims.ClaimsTables.from_bronze(spark, paths)


def test_definitions(tables, rows):
    got = claims.definitions(tables, claims.CohortSpec())
    pct = lambda n: pytest.approx(n / 7 * 100)
    # p7 takes a listed drug (a JAK inhibitor) in one month
    assert rows(got) == [("def_0", 6, pct(6)), ("def_2", 6, pct(6)), ("def_3", 4, pct(4)), ("def_4", 1, pct(1))]


def test_layers(spark, tables, rows, tmp_path):
    spec = claims.CohortSpec()
    for _ in range(2):  # a second run replaces the first
        written = claims.run(tables, spec, str(tmp_path))
    assert written["cohort"] == 4 and written["definitions_summary"] == 4

    cohort = {r["common_key"]: r for r in scan_table(spark, f"{tmp_path}/silver/cohort").collect()}
    assert set(cohort) == {"p1", "p2", "p4", "p6"}
    assert [cohort["p1"][c] for c in ("MTX", "TNFI", "bDMARDs", "any_DMARD", "LEF", "TJR", "any_RA_surgery")] == [1, 1, 1, 1, 0, 1, 1]
    assert [cohort["p2"][c] for c in ("CS", "bDMARDs", "any_RA_surgery")] == [1, 0, 0]
    assert cohort["p6"]["age_group"] is None and cohort["p4"]["prescription_months"] == 7
    assert [f.name for f in schemas.SILVER["cohort"]] == scan_table(spark, f"{tmp_path}/silver/cohort").columns

    ages = {r["age_group"]: r for r in scan_table(spark, f"{tmp_path}/gold/age_distribution").collect()}
    assert ages["Total"]["n"] == 4 and ages["Total"]["prevalence"] == 57.14 and ages["Total"]["paper_prevalence"] == 0.65
    assert ages["Total"]["pct_of_total"] == 100.0 and ages["Total"]["fm_ratio"] == 1.0
    assert ages["40-49"]["n"] == 1 and ages["40-49"]["prevalence"] == 50.0 and ages["40-49"]["fm_ratio"] is None
    assert ages[None]["prevalence"] is None

    drugs = {r["age_group"]: r for r in scan_table(spark, f"{tmp_path}/gold/medication_usage").collect()}
    assert drugs["Total"]["MTX"] == 100.0 and drugs["Total"]["TNFI"] == 25.0 and drugs["Total"]["TNFI_ABT_ratio"] == 1.0
    assert drugs["Total"]["IGT"] == 0.0 and drugs["16-19"]["TNFI_ABT_ratio"] is None

    surgery = {r["age_group"]: r for r in scan_table(spark, f"{tmp_path}/gold/procedure_usage").collect()}
    assert surgery["Total"]["any_RA_surgery"] == 25.0 and surgery["85+"]["ULTRASOUND"] == 100.0

    summary = {r["metric"]: r["reproduced"] for r in scan_table(spark, f"{tmp_path}/gold/summary").collect()}
    assert summary["Total RA Patients (Definition 3)"] == "4" and summary["Prevalence (%)"] == "57.14"
    assert summary["Age >= 85 years (%)"] == "33.3" and summary["RA Surgery Rate (%)"] == "25.00"


def test_threshold_zero_keeps_members_without_drugs(tables, rows):
    spec = claims.CohortSpec(min_months=0)
    got = {r["common_key"]: r for r in claims.master(tables, spec).collect()}
    assert set(got) == {"p1", "p2", "p3", "p4", "p6", "p7"}
    assert got["p7"]["JAKi"] == 1 and got["p7"]["prescription_months"] == 1


def test_invariants(tables):
    spec = claims.CohortSpec(min_months=0)
    master = claims.master(tables, spec)
    flags = [*spec.drug_groups, *spec.procedure_groups, *spec.composites]
    bad = master.filter(~F.array_contains(F.lit([0, 1]), F.col(flags[0])))
    for f in flags[1:]:
        bad = bad.unionByName(master.filter(~F.col(f).isin(0, 1)))
    assert bad.count() == 0
    for name, members in spec.composites.items():
        assert master.filter(F.greatest(*members) > F.col(name)).count() == 0
