"""The claims study bound to the star-schema files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataspark.plans.claims import ClaimsTables, CohortSpec, candidate_claims, candidates, exposed_candidates, master
from strataspark.session import scratch_path
from strataspark.sources import star
from strataspark.sources.tables import scan_table, write_overwrite

STAR_SPEC = CohortSpec(
    diagnosis_codes=tuple(star.DIAGNOSIS_BRANDS),
    exposure_codes=tuple(star.EXPOSURE_TYPES),
    drug_groups=star.TYPE_GROUPS,
    procedure_groups=star.RETURN_FLAGS,
    composites={
        "bDMARDs": ["TNFI", "IL6I", "ABT"],
        "any_DMARD": ["MTX", "SSZ", "LEF", "TNFI", "IL6I", "ABT"],
        "any_RA_surgery": ["TJR"],
    },
)


def star_claims(spark: SparkSession, folder: str) -> ClaimsTables:
    return ClaimsTables(
        patients=star.patients(spark, folder),
        receipts=star.receipts(spark, folder),
        disease=star.disease_lines(spark, folder),
        medication=star.medication_lines(spark, folder),
        procedure=star.procedure_lines(spark, folder),
    )


def star_master(spark: SparkSession, folder: str) -> DataFrame:
    """The cohort; candidates, their claims and their exposure are stored, since each is used more than once."""
    claims, path = star_claims(spark, folder), scratch_path(spark, "silver")
    write_overwrite(candidates(claims, STAR_SPEC), f"{path}/keys")
    people = scan_table(spark, f"{path}/keys")
    write_overwrite(candidate_claims(claims, people), f"{path}/claims")
    own_claims = scan_table(spark, f"{path}/claims")
    write_overwrite(exposed_candidates(claims, STAR_SPEC, people, own_claims), f"{path}/exposed")
    return master(claims, STAR_SPEC, scan_table(spark, f"{path}/exposed"), own_claims)
