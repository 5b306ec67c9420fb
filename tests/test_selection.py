from __future__ import annotations

import math
import random

import numpy as np
import pytest

from gustara.operators import aggregates as A
from gustara.operators import selection as S


def _frame(spark):
    rnd = random.Random(5)
    wide = [rnd.choice((-1, 1)) * math.ldexp(rnd.random(), rnd.randint(-1070, 1020)) for _ in range(700)]
    close = [math.nextafter(1.0, 2.0) + i * 2**-52 for i in range(500)] + [1e300, -1e300]
    ties = [rnd.choice((0.0, -0.0, 1.0, 1.0, 1.0, 7.5)) for _ in range(700)]
    columns = [wide, close + [None] * 198, ties]
    return spark.createDataFrame(list(zip(*columns, strict=True)), "wide double, close double, ties double").repartition(5), columns


def test_positions_of_many_columns_match_sorting(spark):
    df, columns = _frame(spark)
    found = S.select_positions(df, ["wide", "close", "ties"], lambda n: range(0, n, 7))
    for values, got in zip(columns, found, strict=True):
        ordered = sorted(v for v in values if v is not None)
        assert got == {p: ordered[p] for p in range(0, len(ordered), 7)}


def test_infinities_and_nan_sort_as_spark_sorts_them(spark):
    values = [3.0, float("inf"), float("nan"), -2.0, float("-inf"), None, 5e-324, -5e-324]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    (found,) = S.select_positions(df, ["v"], range)
    assert [found[i] for i in range(6)] == [float("-inf"), -2.0, -5e-324, 5e-324, 3.0, float("inf")]
    assert math.isnan(found[6]) and len(found) == 7


def test_empty_and_null_columns_have_null_quantiles(spark):
    df = spark.createDataFrame([(None, 1)], "a double, b int")
    assert S.select_quantiles(df, ["a", "b"], (0.5,)) == {"a": [None], "b": [1.0]}
    assert S.select_quantiles(df.where("b > 1"), ["a", "b"], (0.5,)) == {"a": [None], "b": [None]}
    empty = A.describe(df.where("b > 1"), ["a", "b"]).collect()
    assert [(r["column_name"], r["n_values"], r["q50"], r["max"]) for r in empty] == [("a", 0, None, None), ("b", 0, None, None)]


def test_quantiles_interpolate_like_numpy(spark):
    df, columns = _frame(spark)
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    found = S.select_quantiles(df, ["ties", "close"], shares)
    assert found["ties"] == pytest.approx(list(np.quantile(columns[2], shares)))
    assert found["close"] == pytest.approx(list(np.quantile([v for v in columns[1] if v is not None], shares)))


def test_columns_share_each_pass_and_nothing_is_sorted(spark, monkeypatch):
    df, _ = _frame(spark)
    passes, plans, counted = [], [], S._counted

    def watched(frame, cells):
        passes.append(len(cells))
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return counted(frame, cells)

    monkeypatch.setattr(S, "_counted", watched)
    described = A.describe(df, ["wide", "close", "ties"])
    assert passes[0] == 3 and len(passes) <= 7
    assert not any("Sort" in p or "rangepartitioning" in p for p in plans)
    plan = described._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and plan.count("HashAggregate") <= 4
