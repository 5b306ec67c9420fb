"""The registered queries and the pipeline over whole small tables, against their SQL or their parts."""

from __future__ import annotations

import os
import sys

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as entry_module
from gustara.llm import queries

sys.path.insert(0, os.path.join(os.path.dirname(entry_module.__file__), "tools"))
from check_oracles import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = entry_module.queries()[key](spark, SF).toPandas()
    assert compare(got, con.execute(entry_module.oracle_sql()[key]).df()).startswith("ok")


def test_pipeline_keeps_clean_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "decontamination", "byte_bpe"]
    given = spark.read.parquet(f"{SF}/documents.parquet")
    kept = entry_module.queries()["pipeline"](spark, SF)
    assert kept.columns[: len(given.columns)] == given.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(set(ids)) == len(ids) and 100 < len(ids) < given.count()
