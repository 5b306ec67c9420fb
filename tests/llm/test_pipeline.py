"""run() against plain forms of its stages, in order, over a whole small table."""

from __future__ import annotations

import os
import re

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gustara.llm import byte_bpe, queries, toxicity
from gustara.llm.common import prepare
from gustara.session import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def kept(spark):
    """The documents before the first stage and after each one, as frames of doc_id and text."""
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out[name] = docs.toPandas()
    return out


def test_run_gives_the_rows_of_its_stages(spark, kept):
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values("doc_id")
    want = kept["byte_bpe"].sort_values("doc_id")
    assert got["doc_id"].tolist() == want["doc_id"].tolist() and got["text"].tolist() == want["text"].tolist()


def test_toxicity_keeps_what_scores_below_a_half(spark, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity.score_toxicity(docs, model).where(F.col("score") < 0.5).select("doc_id").toPandas()
    assert sorted(scores["doc_id"]) == sorted(kept["toxicity"]["doc_id"])


def test_line_dedup_is_its_sql(kept):
    con = duckdb.connect()
    con.register("documents", kept["toxicity"][["doc_id", "text"]])
    want = con.execute(queries.ORACLES["op7_line_dedup"]).df()
    emptied = (want["n_removed"] > 0) & (want["text"].fillna("").str.strip() == "")
    want = dict(zip(want["doc_id"][~emptied], want["text"][~emptied]))
    assert want == dict(zip(kept["line_dedup"]["doc_id"], kept["line_dedup"]["text"]))


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]


def test_near_dedup_leaves_one_of_equal_texts_and_all_that_share_no_words(kept):
    before, after = kept["line_dedup"], kept["minhash_near_dedup"]
    said = {i: tuple(words(t)) for i, t in zip(before["doc_id"], before["text"])}
    shingles = {i: {w[n : n + 5] for n in range(len(w) - 4)} for i, w in said.items()}
    alive = set(after["doc_id"])
    for i in said:
        equal = [j for j in said if said[j] == said[i] and said[i]]
        assert not equal or len(alive & set(equal)) <= 1
        if not any(j != i and shingles[i] & shingles[j] for j in said) and len(equal) <= 1:
            assert i in alive


def test_decontamination_by_all_alignments(kept):
    """13 matching tokens in a row are always found; without 8 matches at any alignment nothing is."""
    items = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").df()["text"]
    code: dict[str, int] = {}

    def coded(text):
        return np.array([code.setdefault(w, len(code)) for w in re.findall(r"[^\W_]+", text.lower())], np.int64)

    passages, before, alive = [coded(t) for t in items], kept["minhash_near_dedup"], set(kept["decontamination"]["doc_id"])
    for i, text in zip(before["doc_id"], before["text"]):
        tokens, best, aligned = coded(text), 0, False
        for item in passages:
            for at in range(1 - len(item), len(tokens)):
                low, high = max(at, 0), min(at + len(item), len(tokens))
                same = tokens[low:high] == item[low - at : high - at]
                if same.sum() >= 8:  # the least that any mask counts
                    aligned = True
                    run = np.diff(np.concatenate([[0], np.flatnonzero(~same) + 1, [len(same) + 1]])) - 1
                    best = max(best, int(run.max()))
        if best >= 13:
            assert i not in alive
        if not aligned:
            assert i in alive


def test_tokens_are_those_of_the_library(kept):
    ranks = byte_bpe.read_ranks(byte_bpe.vocabulary_path())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=ranks)
    last = kept["byte_bpe"]
    assert last["doc_id"].tolist() == kept["decontamination"]["doc_id"].tolist() or len(last) == len(kept["decontamination"])
    for text, tokens, n in zip(last["text"], last["tokens"], last["n_tokens"]):
        ids = library.encode_ordinary(text)
        assert np.frombuffer(tokens, "<u4").tolist() == ids and n == len(ids)
