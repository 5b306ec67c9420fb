"""The stages of the corpus pipeline: each takes documents and gives the rows that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustara.llm import byte_bpe, line_dedup, toxicity
from gustara.llm.common import named, numbered, prepare, table, without


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labelled rows, does not call toxic."""
    prepare(spark)
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs.

    A document of which only blank lines are left was a copy as a whole and goes; ``n_chars``, if
    there is one, is the length of the text that stays.
    """
    prepare(spark)
    rows = docs.select(*numbered(docs))
    said = F.col(f"__c{docs.columns.index('text')}")
    ids, texts = (f"__c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    done = line_dedup.dedup_lines(rows, ids, texts, out="removed")
    emptied = (F.col("removed") > 0) & (F.trim(F.regexp_replace(said, r"\s+", " ")) == "")
    left = done.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        given = f"__c{docs.columns.index('n_chars')}"
        length = F.length(said).cast(docs.schema["n_chars"].dataType)
        left = left.withColumn(given, F.when(F.col("removed") > 0, length).otherwise(F.col(given)))
    return left.select(*named(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    from gustara.llm import order_minhash

    prepare(spark)
    return order_minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    from gustara.llm import decontaminate

    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``n_tokens`` and ``tokens`` (packed ids); texts that do not decode to themselves fail.

    Columns of these names in the documents are replaced.
    """
    prepare(spark)
    encoded = byte_bpe.round_trip(docs, decoded=None, keep=without(docs, ["tokens", "n_tokens"]))
    return encoded.withColumn("n_tokens", (F.octet_length("tokens") / 4).cast("bigint"))
