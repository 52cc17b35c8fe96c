"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. The quality classifier drops documents that it rejects (score under 0.3). It is fitted on ``labels``, on at most
   4000 rows that aren't held out; every document is scored, and unlabelled ones are kept like any other by their score.
2. SimHash keeps one document, the smallest id, of each group of near duplicates; unlike rows of one id all stay.
3. Suffix-array dedup removes passages of 50 bytes and more that an earlier kept document holds. A document that loses
   all its text stays with an empty one.
4. Sources are interleaved to their target weights; the rows are stored in that order and none is lost. A short last block
   of a source leaves positions out, never rows.
5. Documents are packed into windows of 2048 tokens, range by range of the mixture; ``sequence_id`` ascends with the
   ranges, and within one it follows the order in which windows fill. The result has one row per piece.

Stages 1 to 4 return the columns of their input, whatever else it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.mixing import WEIGHTS, mix_order, mixed
from lorespark.llm.packing import pack
from lorespark.llm.quality import fit_quality, score_quality
from lorespark.llm.simhash import keep_one
from lorespark.llm.suffix_dedup import dedup_texts
from lorespark.session import materialise, spread

THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    score = "_quality"
    while score in docs.columns:
        score += "_"
    return score_quality(docs, fit_quality(docs, labels), score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each component of near duplicates."""
    return keep_one(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take later copies of long passages out of the texts."""
    return dedup_texts(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order of the mixture."""
    return mixed(docs, WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents in the order of the mixture; one row per piece.

    Reading files back doesn't keep their order, so the schedule is computed again.
    """
    ordered = mix_order(docs.select("doc_id", "source", "text"), WEIGHTS).repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return pack(ordered.select("doc_id", "text"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeated_passage_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Hashing, training and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder before the next reads it."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.split(" ")[0])
    return STAGES[-1][1](spark, docs, sf_dir)
