"""The corpus pipeline: language ID, toxicity, near-duplicate removal, packing; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressleaf.llm import pipeline
from pressleaf.llm.common import cut, table

STAGES = [
    ("language", pipeline.language),
    ("toxicity", pipeline.toxic),
    ("near_duplicates", pipeline.near_duplicates),
    ("packing", pipeline.pack),
]

#: No stage but the third has a form in SQL: language and toxicity are learned models, packing is a search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
