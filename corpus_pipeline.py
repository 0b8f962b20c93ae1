"""From raw documents to packed training sequences, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import stages
from weftline.llm.common import Scratch, table

STAGES = [
    ("toxicity", stages.toxicity),
    ("exact_dedup", stages.exact),
    ("near_dedup", stages.near),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: The classifier, the similarity classes and the packing are not SQL; a test compares all stages with plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each reads what its predecessor has written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
