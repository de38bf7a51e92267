"""A corpus pipeline: quality classifier, line dedup, near-dedup, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelweave.llm import grades, lines, mixing, neardup, packing
from voxelweave.plans.tables import cut, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on ``labels`` and let the rejected documents go."""
    model = grades.train(grades.graded(docs, read(spark, sf_dir, "labels")))
    return grades.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that a document with a smaller id has."""
    return lines.drop_repeated_lines(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return neardup.keep_one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin out documents until the sources have their targets."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids, as pieces of documents."""
    return packing.piece_digests(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None
