"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import bpe, decontamination, line_dedup, quality_rules, shingle_join
from quillstream.llm.common import cut

STAGES = [
    ("quality rules", quality_rules.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", shingle_join.stage),
    ("benchmark decontamination", decontamination.stage),
    ("BPE encoding and decoding", bpe.stage),
]

#: The last three stages are beyond SQL: similarity groups of any length and a tokenizer. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
