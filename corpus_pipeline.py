"""The corpus pipeline: five operators of ``modelwake.llm``, each over what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of ``docs``; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modelwake.llm import lines, minhash, mixing, packing, quality
from modelwake.llm.common import Stages
from modelwake.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity the trusted documents of their language do not exceed."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.passing_quality(docs, labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across sites."""
    return lines.without_boilerplate(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (five-word shingles, similarity 0.8)."""
    return minhash.without_near_duplicates(docs, width=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens meet the target weights."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.packed_pieces(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packed),
]

#: No SQL states perplexity, near copies or tokens; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is stored in the shared folder and read again."""
    stages = Stages(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES, start=1):
        result = stage(spark, docs, sf_dir)
        if place == len(STAGES):
            return result
        before, docs = docs, stages.keep(result)
        if place > 1:
            stages.drop(before)
    return docs
