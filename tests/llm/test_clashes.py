"""Given columns that are named like the operators' own stay as they are, in every stage and operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gustara.llm import byte_bpe, decontaminate, language_id, order_minhash, secret_scan, stages, token_counts, toxicity
from gustara.llm.common import prepare

SF = "/root/testdata/sf0.001"
NAMES = (
    "__fed fed c0 c1 __gone gone __id id __rank place __removed removed __toxicity toxicity __decoded decoded __kinds __key __clean kinds key "
    "said __c0 __c1 __c2 __side bucket h1 h2 n kind node line version no_id doc component class_id class_size low trigram at seed item matched"
).split()


@pytest.fixture(scope="module")
def given(spark):
    docs = prepare(spark).read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    null = spark.createDataFrame([(None, None, None, None, None), (7001, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(null)
    return docs, docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(c) for c in NAMES])


STAGES = [stages.toxicity_stage, stages.line_dedup_stage, stages.near_dedup_stage, stages.decontamination_stage, stages.byte_bpe_stage]


@pytest.mark.parametrize("stage", STAGES, ids=lambda s: s.__name__)
def test_stages_keep_given_columns(spark, given, stage):
    plain, wide = given
    want = stage(spark, plain, SF)
    got = stage(spark, wide, SF)
    assert got.columns[: len(wide.columns)] == wide.columns
    key = ["doc_id", "text"]
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    for row in got.select(*key, *NAMES).collect():
        assert all(row[c] == f"{c}:{-1 if row['doc_id'] is None else row['doc_id']}" for c in NAMES)
    assert stage(spark, wide.limit(0), SF).count() == 0


def test_operators_keep_given_columns(spark, given):
    plain, wide = given
    model = toxicity.fit_toxicity(plain, spark.read.parquet(f"{SF}/labels.parquet"))
    languages = language_id.fit_language(plain.where("text is not null"))
    runs = [
        lambda d: byte_bpe.decode_documents(byte_bpe.encode_documents(d, out="ids"), "ids", out="bytes"),
        lambda d: byte_bpe.round_trip(d, out="ids", decoded="bytes"),
        lambda d: language_id.identify_language(d, languages),
        lambda d: toxicity.score_toxicity(d, model),
        lambda d: token_counts.token_counts(d),
        lambda d: secret_scan.scan_secrets(d),
        lambda d: order_minhash.keep_one(d),
        lambda d: decontaminate.drop_contaminated(d, spark.read.parquet(f"{SF}/benchmark.parquet")),
    ]
    for run in runs:
        want, got = run(plain), run(wide)
        assert set(NAMES) <= set(got.columns)
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
        row = got.where("doc_id = 7001").first()
        assert row is None or all(row[c] == f"{c}:7001" for c in NAMES)


def test_short_benchmark_items_are_found(spark):
    docs = prepare(spark).createDataFrame(
        [(1, "He asked: what is the Capital of France, and left."), (2, "the capital of a country"), (3, "yes"), (4, None)], "doc_id bigint, text string"
    )
    items = [(1, "what is the capital of France"), (2, "Capital of"), (3, "yes"), (4, ""), (5, None), (6, "no such words here at all")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc"], r["item"], r["matched"], r["at"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(1, 1, 6, 2), (1, 2, 2, 5), (2, 2, 2, 1), (3, 3, 1, 0)}
    longer = decontaminate.contaminated(docs, benchmark, min_tokens=3).collect()
    assert {(r["doc"], r["item"]) for r in longer} == {(1, 1)}
