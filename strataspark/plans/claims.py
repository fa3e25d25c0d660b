"""The claims study: code- and exposure-based cohort, wide flags, age-stratified tables.

Inputs are long claims tables; the stages are lazy DataFrames.  ``run`` writes
the silver and gold layers, reading each layer back from its files so that a
later stage never repeats an earlier one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.bands import band_left_closed
from strataspark.functions.scalar import safe_ratio
from strataspark.operators import cohort as co
from strataspark.operators import rates as ra
from strataspark.operators.report import metric_report
from strataspark.sources import codes
from strataspark.sources.schemas import GOLD, SILVER
from strataspark.sources.tables import scan_table, write_overwrite


@dataclass(frozen=True)
class CohortSpec:
    """The settings of a claims cohort; the defaults are the published study's."""

    diagnosis_codes: Sequence[str] = tuple(codes.DIAGNOSIS_CODES)
    exposure_codes: Sequence[str] = tuple(codes.flatten(codes.DRUG_GROUPS))
    drug_groups: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {**codes.DRUG_GROUPS, "CS": codes.STEROID_CODES}
    )
    procedure_groups: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {p: [p] for p in codes.PROCEDURE_TYPES}
    )
    composites: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {
            "bDMARDs": codes.BIOLOGIC_GROUPS,
            "any_DMARD": list(codes.DRUG_GROUPS),
            "any_RA_surgery": codes.SURGERY_TYPES,
        }
    )
    min_months: int = 2
    definitions: Mapping[str, int] = field(default_factory=lambda: dict(codes.DEFINITIONS))
    age_edges: Sequence[float] = tuple(codes.AGE_EDGES)
    age_labels: Sequence[str] = tuple(codes.AGE_LABELS)


@dataclass(frozen=True)
class ClaimsTables:
    """Long claims tables with a ``code`` column, keyed by person and/or claim."""

    patients: DataFrame
    receipts: DataFrame
    disease: DataFrame
    medication: DataFrame
    procedure: DataFrame

    @classmethod
    def from_bronze(cls, spark, tables: Mapping[str, str]) -> "ClaimsTables":
        """From stored bronze tables under their declared names."""
        return cls(
            patients=scan_table(spark, tables["patients"]),
            receipts=scan_table(spark, tables["re_receipt"], ["receipt_id", "common_key", "service_month"]),
            disease=scan_table(spark, tables["sy_disease"]).select(
                "common_key", "receipt_id", F.col("icd10_code").alias("code")
            ),
            medication=scan_table(spark, tables["iy_medication"]).select(
                "common_key", "receipt_id", F.col("drug_code").alias("code")
            ),
            procedure=scan_table(spark, tables["si_procedure"]).select(
                "common_key", "receipt_id", F.col("procedure_type").alias("code")
            ),
        )


def candidates(tables: ClaimsTables, spec: CohortSpec) -> DataFrame:
    return co.cohort_by_code(tables.disease, spec.diagnosis_codes, claims=tables.receipts)


def exposure(tables: ClaimsTables, spec: CohortSpec) -> DataFrame:
    return co.exposure_months(tables.medication, tables.receipts, spec.exposure_codes)


def members(tables: ClaimsTables, spec: CohortSpec) -> DataFrame:
    return co.cohort_by_exposure(candidates(tables, spec), exposure(tables, spec), spec.min_months)


def candidate_claims(tables: ClaimsTables, people: DataFrame) -> DataFrame:
    """The candidates' claims; stored once, they stand for claims and candidates in every pass over facts."""
    return co.claims_of(tables.receipts.select("receipt_id", "common_key", "service_month"), people)


def exposed_candidates(
    tables: ClaimsTables, spec: CohortSpec, people: DataFrame | None = None, own_claims: DataFrame | None = None
) -> DataFrame:
    """Every candidate with exposure months and drug flags, one row per person.

    One pass over the diagnosis facts and one over the medication facts; each
    definition of the cohort is a filter on the result.  Only the candidates'
    medication facts are aggregated: give ``people``, the candidates, and
    ``own_claims``, their claims, when they are already stored.
    """
    people = candidates(tables, spec) if people is None else people
    drugs = co.flags_and_months(
        tables.medication, tables.receipts, spec.drug_groups, spec.exposure_codes, members=people, own_claims=own_claims
    )
    return co.with_exposure(people, drugs)


def master(
    tables: ClaimsTables, spec: CohortSpec, exposed: DataFrame | None = None, own_claims: DataFrame | None = None
) -> DataFrame:
    """One row per member with attributes, months and flags.

    ``exposed`` is :func:`exposed_candidates` and ``own_claims``
    :func:`candidate_claims`, given when they are already stored.
    """
    exposed = exposed_candidates(tables, spec) if exposed is None else exposed
    chosen = exposed.filter(F.col("prescription_months") >= spec.min_months)
    procedures = co.flag_pivot(
        tables.procedure, spec.procedure_groups, listed_only=True, claims=tables.receipts, members=chosen, own_claims=own_claims
    )
    persons = tables.patients.withColumn(
        "age_group", band_left_closed(F.col("age"), spec.age_edges, spec.age_labels)
    )
    return co.cohort_master(
        chosen,
        persons,
        [(procedures, list(spec.procedure_groups))],
        spec.composites,
    )


def definitions(tables: ClaimsTables, spec: CohortSpec, exposed: DataFrame | None = None) -> DataFrame:
    if exposed is None:
        exposed = co.with_exposure(candidates(tables, spec), exposure(tables, spec))
    return co.definition_summary(exposed, tables.patients, spec.definitions)


def age_distribution(cohort: DataFrame, population: DataFrame, spec: CohortSpec, published: DataFrame | None = None) -> DataFrame:
    banded = population.withColumn("age_group", band_left_closed(F.col("age"), spec.age_edges, spec.age_labels))
    return ra.stratum_distribution(cohort, banded, "age_group", labels=spec.age_labels, published=published)


def medication_usage(
    cohort: DataFrame,
    spec: CohortSpec,
    ratio: tuple[str, str] | None = ("TNFI", "ABT"),
    digits: int = 1,
    total_from_rounded: bool = False,
) -> DataFrame:
    """Drug rates by age band with a total; ``ratio`` names two groups to divide, or None for the rates alone."""
    flags = [*spec.drug_groups, "bDMARDs"]
    if ratio is None:
        return ra.rates_with_total(cohort, "age_group", flags, spec.age_labels, digits)
    name = f"{ratio[0]}_{ratio[1]}_ratio"
    return ra.rates_with_ratio(cohort, "age_group", flags, *ratio, name, spec.age_labels, digits, total_from_rounded)


def procedure_usage(cohort: DataFrame, spec: CohortSpec) -> DataFrame:
    return ra.rates_with_total(
        cohort, "age_group", [*spec.procedure_groups, "any_RA_surgery"], spec.age_labels, digits=2
    )


def summary(cohort: DataFrame, population: DataFrame) -> DataFrame:
    """Headline numbers beside the published ones."""
    people = population.agg(F.count(F.lit(1))).scalar()
    n = F.count(F.lit(1))

    def pct(test):
        return F.avg(test.cast("int")) * 100

    measures = [
        (n, ",", "members of the main definition"),
        (safe_ratio(n, people, 100.0), "%.2f", "members per person"),
        (pct(F.col("sex") == "2"), "%.1f", "women"),
        (pct(F.col("age") >= 65), "%.1f", "65 and over"),
        (pct(F.col("age") >= 85), "%.1f", "85 and over"),
        (F.avg("MTX") * 100, "%.1f", "methotrexate"),
        (F.avg("bDMARDs") * 100, "%.1f", "biologics"),
        (F.avg("CS") * 100, "%.1f", "steroids"),
        (F.avg("any_RA_surgery") * 100, "%.2f", "joint surgery"),
    ]
    # The published summary names the measures, in this order.
    named = [(name, *measure) for name, measure in zip(codes.PUBLISHED_SUMMARY, measures, strict=True)]
    return metric_report(cohort, named, codes.PUBLISHED_SUMMARY)


def run(tables: ClaimsTables, spec: CohortSpec, target: str, declared: bool = True) -> dict[str, int]:
    """Write all silver and gold tables below a folder; returns rows per table.

    ``declared`` asserts the published study's schemas, which a cohort with
    other groups does not have.

    The folder must be shared by the executors.  Each table replaces its former
    state, so a run that was cut off is simply repeated.
    """
    spark = tables.patients.sparkSession
    written: dict[str, int] = {}

    def store(layer: str, name: str, df: DataFrame, schema=None) -> DataFrame:
        path = f"{target}/{layer}/{name}"
        written[name] = write_overwrite(df, path, schema if declared else None)
        return scan_table(spark, path)

    keys, claims = f"{target}/silver/candidate_keys", f"{target}/silver/candidate_claims"
    write_overwrite(candidates(tables, spec), keys)
    people = scan_table(spark, keys)
    write_overwrite(candidate_claims(tables, people), claims)
    own_claims = scan_table(spark, claims)
    exposed = store("silver", "candidates", exposed_candidates(tables, spec, people, own_claims))
    cohort = store("silver", "cohort", master(tables, spec, exposed, own_claims), SILVER["cohort"])
    store("silver", "definitions_summary", definitions(tables, spec, exposed), SILVER["definitions_summary"])
    published = codes.reference_values(
        spark, codes.PUBLISHED_AGE_TABLE, "age_group", ["paper_pct", "paper_prevalence"]
    )
    store(
        "gold", "age_distribution",
        age_distribution(cohort, tables.patients, spec, published), GOLD["age_distribution"],
    )
    store("gold", "medication_usage", medication_usage(cohort, spec), GOLD["medication_usage"])
    store("gold", "procedure_usage", procedure_usage(cohort, spec), GOLD["procedure_usage"])
    store("gold", "summary", summary(cohort, tables.patients), GOLD["summary"])
    return written
