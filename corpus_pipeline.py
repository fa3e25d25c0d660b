"""From raw documents to a training order in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's documents.  All but the
last return the columns of ``documents``.

* ``quality_rules``: documents that the production policy rejects go.
* ``simhash_dedup``: one document of each group linked by fingerprints of
  four-word shingles that differ in at most four bits stays, the one with the
  smallest id.
* ``decontaminate``: documents that hold a benchmark window go.
* ``mask_pii``: spans of personal data become masks; every document stays.
* ``mix_sources``: sources are mixed to their target weights; a row is one
  placement of a whole document, with its round, training position and words,
  in order of position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm import decontaminate, mixing, pii, quality, simhash
from strataspark.llm.common import stored
from strataspark.llm.suite import MIX_TILTS, MIX_WEIGHTS


def _quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = [c for c in docs.columns]
    # The texts are kept beside the measurements, which may not take a name of theirs.
    packed = docs.select("text", F.struct(*names).alias("_doc"))
    return quality.ledger(packed).filter(~quality.rejected(quality.PRODUCTION)).select("_doc.*")


def _simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=4, radius=4)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.masked(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def _mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    assigned = mixing.assign(mixing.sized(docs), mixing.ranked_knots(MIX_WEIGHTS, MIX_TILTS), whole=True)
    return mixing.in_training_order(assigned)


STAGES = [
    ("quality_rules", _quality_rules),
    ("simhash_dedup", _simhash_dedup),
    ("decontaminate", _decontaminate),
    ("mask_pii", _mask_pii),
    ("mix_sources", _mix_sources),
]

# Fingerprints of XXH64 values and the trained span classifier have no SQL form; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
