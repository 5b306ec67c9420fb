"""Ranks and positions against pandas, including one group with most of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gustara.operators import aggregates as A
from gustara.operators.ordering import competition_rank, first_per_group, running_position, top_k
from gustara.operators.weights import index_ids


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"u{i % 50}", i, float(rng.randrange(40))) for i in range(6000)]
    return spark.createDataFrame(data, "g string, id int, score double").repartition(7).cache()


def test_positions_cover_every_group(skewed):
    got = running_position(skewed, ["g"], [("score", False), ("id", True)], "pos").toPandas()
    want = got.sort_values(["g", "score", "id"], ascending=[True, False, True])
    want["w"] = want.groupby("g").cumcount() + 1
    assert (want["pos"] == want["w"]).all()


def test_global_position(skewed):
    got = running_position(skewed, [], [("id", True)], "pos").toPandas()
    assert (got["pos"] == got["id"] + 1).all()


def test_competition_rank_shares_the_lowest_rank(skewed):
    got = competition_rank(skewed, ["g"], "score", "r").toPandas()
    assert len(got) == 6000
    want = got.groupby("g")["score"].rank(ascending=False, method="min")
    assert (got["r"] == want).all()


def test_all_scores_equal(spark):
    df = spark.range(500).select(F.lit("a").alias("g"), F.col("id"), F.lit(1.0).alias("score"))
    assert {r["r"] for r in competition_rank(df, ["g"], "score", "r").collect()} == {1}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_top_k_does_not_depend_on_partitions(skewed, rows, parts):
    order = [F.col("score").desc(), F.col("id").asc()]
    got = rows(top_k(skewed.repartition(parts), ["g"], order, 5), "g", "id", "rank")
    pdf = skewed.toPandas().sort_values(["score", "id"], ascending=[False, True])
    want = [(g, int(i), k + 1) for g, part in pdf.groupby("g") for k, i in enumerate(part["id"].head(5))]
    assert got == sorted(want, key=repr)


def test_top_k_limits_before_the_shuffle(skewed):
    plan = top_k(skewed, ["g"], [F.col("id").asc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_first_per_group(skewed, rows):
    got = rows(first_per_group(skewed, ["g"], ["id"]), "g", "id")
    want = skewed.toPandas().groupby("g")["id"].min()
    assert got == sorted(((g, int(i)) for g, i in want.items()), key=repr)


def test_index_ids_are_sorted_codes(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "10", "9", "b", None, "a"]], "id string")
    assert {r["id"]: r["idx"] for r in index_ids(df, "id", "idx").collect()} == {"10": 0, "9": 1, "a": 2, "b": 3}


def test_quantiles_match_numpy(spark, skewed):
    import numpy as np

    pdf = skewed.toPandas()
    row = A.quantiles(skewed, "score", (0.0, 0.25, 0.333, 0.5, 1.0)).first()
    want = np.quantile(pdf["score"], [0.0, 0.25, 0.333, 0.5, 1.0])
    assert [row[f"q{i}"] for i in range(5)] == pytest.approx(list(want))
    single = A.quantiles(spark.createDataFrame([(3.0,)], "v double"), "v", (0.25,)).first()
    assert single["q0"] == 3.0


def test_describe_matches_pandas(skewed):
    row = A.describe(skewed, ["score"]).first()
    want = skewed.toPandas()["score"].describe()
    assert [row[c] for c in ("n_values", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(
        [want[c] for c in ("count", "mean", "std", "min", "25%", "50%", "75%", "max")]
    )


def test_histogram_edges(spark, rows):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.05, 0.5, 1.0, None, float("nan"))], "v double")
    assert rows(A.histogram(df, "v", 20)) == [(1, 1), (11, 1), (2, 1), (20, 1)]
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert rows(A.histogram(same, "v", 20)) == [(1, 2)]


def test_mean_std_skips_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),)], "v double")
    row = A.mean_std(df, "v").first()
    assert (row["n_values"], row["mean"], round(row["std"], 6)) == (2, 2.0, 1.414214)
