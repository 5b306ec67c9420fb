"""Answers kept in a ledger: equal prompts once, restarts without a repeated call."""

from __future__ import annotations

import os
import sys
import uuid
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gustara.operators.ledger import NOT_ASKED, generate_once, prompt_key
from gustara.providers.base import GenerationParams, Retry

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ONCE = Retry(attempts=1, wait_seconds=0.0, give_up=None)


class Counting:
    """Writes every prompt it answers to a file of its own; fails where a word is in the prompt."""

    def __init__(self, folder, fails=None):
        self.folder, self.fails = folder, fails

    def generate(self, requests, params):
        if self.fails is not None and any(self.fails in (p[1] or "") for p in requests):
            raise ValueError("down")
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as out:
            out.write("\n".join(str(p[1]) for p in requests))
        return [f"answer to {p[1]}" for p in requests]

    def asked(self):
        return Counter(line for name in os.listdir(self.folder) for line in open(os.path.join(self.folder, name)).read().split("\n"))


@pytest.fixture()
def folders(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls"), str(tmp_path / "ledger")


def _run(df, provider, ledger, **options):
    options = {"retry": ONCE, "model": "m", **options}
    return generate_once(df, F.array(F.lit("say"), F.col("text")), provider, ledger, **options)


def test_equal_prompts_are_asked_once_and_all_rows_stay(spark, folders):
    calls, ledger = folders
    rows = [(i, f"t{i % 3}") for i in range(300)] + [(None, None), (7, ""), (7, "")]
    got = _run(spark.createDataFrame(rows, "key int, text string"), Counting(calls), ledger, wave_rows=2).collect()
    assert sorted((r["key"] or -1, r["text"] or "", r["answer_text"]) for r in got) == sorted(
        (k or -1, t or "", f"answer to {t}") for k, t in rows
    )
    assert Counting(calls).asked() == {"t0": 1, "t1": 1, "t2": 1, "None": 1, "": 1}


def test_a_stopped_run_goes_on_without_a_repeated_call(spark, folders):
    calls, ledger = folders
    df = spark.createDataFrame([(i, f"t{i}" if i != 137 else "outage") for i in range(200)], "id int, text string")
    outage = Retry(attempts=1, wait_seconds=0.0, give_up=2)
    options = {"retry": outage, "wave_rows": 20, "batch_rows": 5, "concurrency": 2}
    first = _run(df, Counting(calls, "outage"), ledger, **options).collect()
    answered = {r["id"] for r in first if r["answer_text"] is not None}
    assert 0 < len(answered) < 200
    assert all(r["error"].startswith(NOT_ASKED) for r in first if r["id"] not in answered)
    second = _run(df, Counting(calls), ledger, **options).collect()
    assert len(second) == 200 and all(r["error"] is None for r in second)
    again = Counting(calls).asked()
    assert len(again) == 200 and {t for t, n in again.items() if n > 1} <= {f"t{i}" for i in range(200) if i not in answered}
    assert all(again[f"t{i}"] == 1 for i in answered)


def test_failures_are_asked_again_and_answers_are_not(spark, folders):
    calls, ledger = folders
    df = spark.createDataFrame([("good",), ("bad",), (None,)], "text string")
    first = {r["text"]: r["error"] for r in _run(df, Counting(calls, "bad"), ledger).collect()}
    assert first == {"good": None, "bad": "ValueError: down", None: None}
    second = {r["text"]: r["answer_text"] for r in _run(df, Counting(calls), ledger).collect()}
    assert second == {t: f"answer to {t}" for t in ("good", "bad", None)}
    assert Counting(calls).asked() == {"good": 1, "bad": 1, "None": 1}


def test_model_parameters_and_missing_parts_are_part_of_the_key(spark, folders):
    calls, ledger = folders
    df = spark.createDataFrame([("x",)], "text string")
    for options in ({}, {"model": "other"}, {"params": GenerationParams(temperature=0.1)}, {}):
        assert _run(df, Counting(calls), ledger, **options).count() == 1
    assert Counting(calls).asked() == {"x": 3}
    keys = spark.createDataFrame([(["a", None],), (["a", ""],), (["a"],), (None,), (["a", "null"],)], "p array<string>")
    assert keys.select(prompt_key(F.col("p"), GenerationParams(), "m").alias("k")).distinct().count() == 5


def test_empty_frame(spark, folders):
    calls, ledger = folders
    got = _run(spark.createDataFrame([], "text string"), Counting(calls), ledger)
    assert got.columns == ["text", "full_response", "answer_text", "error"] and got.count() == 0
