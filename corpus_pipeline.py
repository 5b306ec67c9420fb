"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage reads what the one before it kept. ``run`` writes every stage's rows to the folder named by
``spark.checkpoint.dir`` and reads them back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gustara.llm import stages
from gustara.llm.common import prepare
from gustara.session import materialize

STAGES = [
    ("toxicity", stages.toxicity_stage),
    ("line_dedup", stages.line_dedup_stage),
    ("minhash_near_dedup", stages.near_dedup_stage),
    ("decontamination", stages.decontamination_stage),
    ("byte_bpe", stages.byte_bpe_stage),
]

# Trained and hashed stages have no SQL form; tests/llm/test_pipeline.py holds every stage of run() against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages, in order, make of the table ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
