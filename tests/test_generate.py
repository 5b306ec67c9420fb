"""Provider failures, offline providers, judging."""

from __future__ import annotations

import json
import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gustara.functions.text import prompt_parts
from gustara.operators import judge as J
from gustara.operators.generate import embed_text, generate, generate_profiles, generation_failures
from gustara.plans.q_generate import item_profiles
from gustara.providers.base import GenerationParams, Retry
from gustara.providers.offline import HashingProvider, KeywordProvider, ListMatchProvider, ProfileMatchProvider
from gustara.schemas import ITEM_PROFILE

# The providers below travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = Retry(attempts=2, wait_seconds=0.0)


class Picky:
    """Fails on rows that say so."""

    def generate(self, requests, params):
        if any("boom" in parts[1] for parts in requests):
            raise RuntimeError("boom")
        return [json.dumps({"food_type": parts[1]}) if "odd" not in parts[1] else "{not json" for parts in requests]


class Short:
    def generate(self, requests, params):
        return []


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string").coalesce(1)


def test_one_bad_row_costs_only_itself(spark):
    df = texts(spark, ["a", "boom", "odd", None])
    rows = generate_profiles(df, "say", ["text"], Picky(), ITEM_PROFILE, retry=NOW)
    got = {r["id"]: r for r in rows.collect()}
    assert got[0]["profile"]["food_type"] == "a" and got[3]["profile"]["food_type"] == ""
    assert got[1]["error"] == "RuntimeError: boom" and got[1]["full_response"] is None
    assert got[2]["error"] is None and got[2]["profile"]["_bad"] is not None
    assert tuple(generation_failures(rows).first()) == (4, 1, 1)


def test_errors_can_be_raised(spark):
    with pytest.raises(Exception, match="boom"):
        generate(texts(spark, ["boom"]), prompt_parts("x", "text"), Picky(), retry=NOW, raise_errors=True).collect()


def test_wrong_number_of_answers_is_an_error(spark):
    row = generate(texts(spark, ["a"]), prompt_parts("x", "text"), Short(), retry=NOW).first()
    assert "0 answers for 1 requests" in row["error"]


def test_retry_waits_and_gives_up():
    calls = []

    def fail():
        calls.append(time.monotonic())
        raise OSError("down")

    with pytest.raises(OSError):
        Retry(attempts=3, wait_seconds=0.05).call(fail)
    assert len(calls) == 3 and calls[-1] - calls[0] >= 0.1


def test_params_follow_the_request_format():
    assert GenerationParams(1.0, 1024, 2048).as_dict() == {
        "generationConfig": {"temperature": 1.0, "maxOutputTokens": 2048, "thinking_config": {"thinking_budget": 1024}}
    }
    assert "thinking_config" not in GenerationParams(0.0, None).as_dict()["generationConfig"]


def test_the_provider_runs_once_per_row(spark):
    rows = generate(texts(spark, ["a", "b"]), prompt_parts("x", "text"), Picky(), retry=NOW)
    plan = rows.select("full_response", "answer_text", F.length("answer_text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_keyword_provider():
    provider = KeywordProvider(ITEM_PROFILE, {"food_type": (("soup", "starter"), ("cake", "dessert")), "flavor_profile": (("hot", "spicy"), ("sugar", "sweet"))})
    answers = [json.loads(a) for a in provider.generate([["x", "Cake soup CAKE sugar"], ["soup cake", "hot"]], {})]
    assert answers[0]["food_type"] == "dessert" and answers[0]["flavor_profile"] == ["sweet"]
    assert answers[1]["food_type"] == "unknown" and answers[1]["flavor_profile"] == ["spicy"]
    assert list(answers[0]) == [f.name for f in ITEM_PROFILE.fields]


def test_embeddings(spark):
    got = {r["id"]: np.array(r["embedding"]) for r in embed_text(texts(spark, ["a b", "B  a", "", None, "c"]), "text", HashingProvider(32)).collect()}
    assert np.allclose(got[0], got[1]) and np.isclose(np.linalg.norm(got[0]), 1.0)
    assert got[2].size == 0 and got[3].size == 0 and not np.allclose(got[0], got[4])


def test_failing_embeddings_are_empty(spark):
    class Refuses:
        dim = 2

        def embed(self, texts, task_type):
            if "bad" in texts:
                raise ValueError("no")
            return [np.ones(2) for _ in texts]

    got = {r["id"]: r["embedding"] for r in embed_text(texts(spark, ["x", "bad"]), "text", Refuses(), retry=NOW).collect()}
    assert got == {0: [1.0, 1.0], 1: []}


def test_an_outage_ends_the_call_and_bad_rows_do_not():
    calls = []

    def answer(part):
        calls.append(len(part))
        if "bad" in part:
            raise ValueError("no")
        return part

    rows = ["x"] * 900 + ["bad"] + ["y"] * 99
    quick = Retry(attempts=1, wait_seconds=0.0, give_up=12)
    assert quick.isolate(rows, answer, lambda failure: None) == [None if r == "bad" else r for r in rows]
    assert quick.isolate([], answer, lambda failure: None) == []
    calls.clear()
    with pytest.raises(RuntimeError, match="12 calls"):
        quick.isolate(["bad"] * 1000, answer, lambda failure: None)
    assert len(calls) == 12


def judged_input(spark):
    liked, other = json.dumps({"food_type": "soup", "cuisine_type": "thai"}), json.dumps({"food_type": "cake"})
    taste = json.dumps({"food_preferences": ["soup"], "cuisine_preference": "thai"})
    data = []
    for i in range(30):
        u = f"u{i}"
        data += [("vs", u, r, f"i{r}", f"t{r}", taste, liked if r < 3 else other) for r in range(1, 5)]
        data += [("als", u, r, f"j{r}", f"t{r}", taste, liked if r < 2 else other) for r in range(1, 5)]
    data.append(("vs", "alone", 1, "i1", "t", taste, liked))
    return spark.createDataFrame(
        data, "model string, user_id string, rank int, item_id string, title string, user_profile_text string, item_profile_text string"
    )


def test_pointwise_judgement_and_metrics(spark):
    judged = J.judge_pointwise(judged_input(spark), ProfileMatchProvider(), "judge").cache()
    assert judged.where("verdict and confidence = 'high'").count() == 30 * 3 + 1
    assert J.negative_verdicts(judged).count() == 30 * 5
    metrics = J.pointwise_metrics(judged, ("vs", "als"))
    assert metrics.count() == 30
    row = metrics.first()
    assert (row["quality_score_vs"], row["quality_score_als"]) == (0.5, 0.25)
    status = {r["status"]: r["count"] for r in J.approved_recommendations(judged).groupBy("status").count().collect()}
    assert status == {"approved": 91, "experimental": 150}


def test_pairwise_judgement_follows_the_permutation(spark):
    got = J.judge_pairwise(judged_input(spark), ListMatchProvider(), "judge", seed=3, models=("vs", "als")).collect()
    assert len(got) == 30 and {r["preferred_model"] for r in got} == {"A", "B"}
    assert {r["model_selected"] for r in got} == {"vs"}


def test_other_answers_select_nobody(spark):
    class Undecided:
        def generate(self, requests, params):
            return ['{"preferred_model": "both"}' for _ in requests]

    got = J.judge_pairwise(judged_input(spark), Undecided(), "judge", models=("vs", "als")).collect()
    assert {r["model_selected"] for r in got} == {None} and len(got) == 30


def test_catalogue_of_one_file_is_described_by_all_tasks(spark, tmp_path):
    rows = [(i, f"small gear {i}", "Brand#12", "PROMO", i % 50) for i in range(400)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = item_profiles(spark, str(tmp_path))
    assert found.count() == 400 and len(found.inputFiles()) == spark.sparkContext.defaultParallelism
