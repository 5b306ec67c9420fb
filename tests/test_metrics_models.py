"""Metrics, weights, features and models."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gustara.operators import metrics as M
from gustara.operators import weights as WT
from gustara.operators.als import als_fit, als_recommend, unknown_users
from gustara.operators.features import item_features, ranking_matrix, require_same_users, user_features
from gustara.operators.ranker import importance_order, rank_items, rank_model, review_rows, score

RECS = "user_id string, item_id string, rank int"
PAIRS = "user_id string, item_id string"


def test_recall(spark):
    recs = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("u", "c", 3), ("v", "a", 1), ("w", "x", 1)], RECS)
    truth = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "z"), ("u", "c"), ("w", "x"), ("other", "a")], PAIRS)
    gone = spark.createDataFrame([("x",)], "item_id string")
    got = {r["user_id"]: tuple(r)[1:] for r in M.recall_at_k(recs, truth, 2, gone).collect()}
    assert got == {"u": (3, 1, True, 1 / 3), "v": (0, 0, False, None), "w": (0, 0, False, None)}
    repeats = {r["user_id"]: tuple(r)[1:3] for r in M.recall_at_k(recs, truth, 2, distinct_truth=False).collect()}
    assert repeats["u"] == (4, 2)
    summary = M.recall_summary(M.recall_at_k(recs, truth, 2)).first()
    assert summary["n_users"] == 3 and summary["avg_hit_proportion"] == pytest.approx((1 / 3 + 1) / 2)


def test_search_behind_recall_runs_once(spark):
    recs = spark.createDataFrame([("u", "a", 1)], RECS).where(F.rand(1) < 0.9)
    plan = M.recall_at_k(recs, spark.createDataFrame([("u", "a")], PAIRS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rand(1)") == 1


def test_ranking_metrics(spark):
    recs = {"u": ["a", "b", "c", "d", "e"], "v": ["a", "b", "c", "d", "e"], "extra": ["a"]}
    truth = {"u": {"a", "c", "z"}, "v": {"q"}, "none": {"a", "b", "c", "d", "e", "f"}}
    rows = [(u, i, n + 1) for u, items in recs.items() for n, i in enumerate(items)]
    pairs = [(u, i) for u, items in truth.items() for i in items]
    got = M.ranking_metrics(spark.createDataFrame(rows, RECS), spark.createDataFrame(pairs, PAIRS), 5).first()
    possible = {u: min(5, len(t)) for u, t in truth.items()}
    hits = {u: [n + 1 for n, i in enumerate(recs.get(u, [])) if i in t] for u, t in truth.items()}
    assert got["precision_at_k"] == pytest.approx(sum(map(len, hits.values())) / sum(possible.values()))
    ap = [sum((j + 1) / r for j, r in enumerate(hits[u])) / possible[u] for u in truth]
    assert got["map_at_k"] == pytest.approx(sum(ap) / 3)
    ndcg = [
        sum(1 / math.log2(r + 1) for r in hits[u]) / sum(1 / math.log2(i + 2) for i in range(possible[u])) for u in truth
    ]
    assert got["ndcg_at_k"] == pytest.approx(sum(ndcg) / 3)


SCORED = "user_id string, item_id string, rating double, rating_date double, score double"


def test_hit_rate_divides_by_k_and_breaks_ties_by_item(spark):
    rows = [("few", "a", 1.0, 1.0, 1.0), ("few", "b", 1.0, 2.0, 0.0)]
    rows += [("tie", i, 1.0, 1.0, 1.0) for i in "fedcba"]
    rows += [("off", i, 1.0, float(n), float(-n)) for n, i in enumerate("abcdefghij")]
    got = {r["user_id"]: r["hit_rate"] for r in M.hit_rate_at_k(spark.createDataFrame(rows, SCORED)).collect()}
    assert got == {"few": 0.4, "tie": 1.0, "off": 0.0}


def test_graded_ndcg(spark):
    rows = [("u", "a", 3.0, 0.0, 0.1), ("u", "b", 5.0, 0.0, 0.9), ("u", "c", 1.0, 0.0, 0.5), ("z", "a", 0.0, 0.0, 1.0)]
    got = {r["user_id"]: r["ndcg"] for r in M.graded_ndcg_at_k(spark.createDataFrame(rows, SCORED), k=2).collect()}
    want = (5 + 1 / math.log2(3)) / (5 + 3 / math.log2(3))
    assert got["u"] == pytest.approx(want) and got["z"] == 0.0


def test_graded_ndcg_averages_all_orders_of_a_tie(spark):
    rnd = random.Random(3)
    rows = [(u, str(i), float(rnd.randint(0, 5)), 0.0, rnd.choice((0.0, 1.0, 2.0, None))) for u in "ab" for i in range(7)]
    rows += [("hot", str(i), float(i % 3), 0.0, 1.0) for i in range(40)] + [("null", "a", None, 0.0, None)]
    got = {r["user_id"]: r["ndcg"] for r in M.graded_ndcg_at_k(spark.createDataFrame(rows, SCORED), k=4, average_ties=True).collect()}
    for user in "ab":
        mine = [(s if s is not None else -1.0, g) for u, _, g, _, s in rows if u == user]
        orders = [p for p in itertools.permutations(mine) if all(x[0] >= y[0] for x, y in itertools.pairwise(p))]
        dcg = [sum(g / math.log2(i + 2) for i, (_, g) in enumerate(p[:4])) for p in orders]
        ideal = sum(g / math.log2(i + 2) for i, g in enumerate(sorted((g for _, g in mine), reverse=True)[:4]))
        assert got[user] == pytest.approx(sum(dcg) / len(dcg) / ideal)
    assert got["hot"] == pytest.approx((39 / 40) / 2) and got["null"] == 0.0
    assert M.graded_ndcg_at_k(spark.createDataFrame([], SCORED), average_ties=True).collect() == []


def test_results_and_extremes(spark):
    rates = "user_id string, hit_rate double"
    table = M.results_table(spark.createDataFrame([("a", 0.2), ("b", 1.0)], rates), spark.createDataFrame([("a", 0.6), ("b", 1.0)], rates))
    got = {r["user_id"]: (round(r["diff"], 6), round(r["abs_diff"], 6)) for r in table.collect()}
    assert got == {"a": (-0.4, 0.4), "b": (0.0, 0.0)}
    assert [r["user_id"] for r in M.extreme_users(table, 1.0).collect()] == ["b"]
    assert [r["user_id"] for r in M.users_at_most(table, 0.2).collect()] == ["a"]


START = dt.datetime(2024, 1, 1)
ROWS = "user_id string, item_id string, rating double, ts timestamp"


def test_age_bonus(spark):
    three = spark.createDataFrame([("u", "a", 5.0, START), ("u", "b", 5.0, START + dt.timedelta(days=1)), ("u", "c", 1.0, START + dt.timedelta(days=2))], ROWS)
    got = {r["item_id"]: round(r["rating_date"], 6) for r in WT.rating_with_age(three).collect()}
    assert got == {"a": 5.2, "b": 5.1, "c": 1.0}
    assert max(r["rating_date"] for r in WT.rating_with_age(three, clip=True).collect()) == 5.0
    one = spark.createDataFrame([("u", "a", 4.0, START)], ROWS)
    assert WT.rating_with_age(one).first()["rating_date"] == 4.2


def test_confidence(spark):
    df = spark.createDataFrame([("u", "a", 2.0), ("u", "b", 4.0), ("v", "a", 5.0)], "user_id string, item_id string, rating_date double")
    got = {(r["user_id"], r["item_id"]): r["confidence"] for r in WT.confidence(df).collect()}
    assert got[("u", "b")] == pytest.approx(math.log1p(81 / math.sqrt(2)))
    assert got[("v", "a")] == pytest.approx(math.log1p(101))


def test_tfidf_and_bm25_on_a_dense_user(spark):
    """The dense user has an entry for every item, so its weights turn negative."""
    data = [("dense", f"i{n}", 4.0) for n in range(4)] + [("rare", "i0", 9.0)]
    df = spark.createDataFrame(data, "user_id string, item_id string, confidence double")
    got = {(r["user_id"], r["item_id"]): (r["tfidf"], r["bm25"]) for r in WT.bm25_weight(WT.tfidf_weight(df)).collect()}
    idf = {"dense": math.log(4) - math.log(5), "rare": math.log(4) - math.log(2)}
    tf = {(u, i): math.sqrt(v) * idf[u] for u, i, v in data}
    sums = {}
    for (u, i), t in tf.items():
        sums[i] = sums.get(i, 0.0) + t
    mean = sum(sums.values()) / len(sums)
    for key, t in tf.items():
        length = 0.2 + 0.8 * sums[key[1]] / mean
        assert got[key] == pytest.approx((t, t * 101 / (100 * length + t) * idf[key[0]]))
    assert got[("dense", "i1")][0] < 0


def test_user_features(spark):
    monday_evening, sunday = dt.datetime(2024, 1, 1, 18), dt.datetime(2024, 1, 7, 9)
    df = spark.createDataFrame([("u", "a", 5.0, monday_evening), ("u", "a", 2.0, sunday), ("u", "b", 2.0, sunday)], ROWS)
    row = user_features(df).first().asDict()
    assert row["mean_aver_rate"] == 3.0 and row["count_recipes"] == 2 and row["2_stars_rating_received"] == 2
    assert row["monday_review_count"] == 1 and row["sunday_review_count"] == 2 and row["evening_review_count"] == 1
    assert len(row) == 16


@pytest.fixture(scope="module")
def planted(spark):
    """Two groups of users, each reading mostly its own half of the items."""
    rng = random.Random(7)
    seen, held = [], []
    for u in range(60):
        own = [f"i{n:02d}" for n in range(40) if (n < 20) == (u < 30)]
        rng.shuffle(own)
        seen += [(f"u{u}", i, 5.0) for i in own[:12]] + [(f"u{u}", f"i{rng.randrange(40):02d}", 1.0)]
        held += [(f"u{u}", i) for i in own[12:]]
    return spark.createDataFrame(seen, "user_id string, item_id string, rating double").cache(), spark.createDataFrame(held, PAIRS).cache()


def test_als_finds_planted_groups(spark, planted):
    seen, held = planted
    fitted = als_fit(seen, rank=8, max_iter=8, blocks=2)
    recs = als_recommend(fitted, seen, 8).cache()
    assert recs.join(seen, ["user_id", "item_id"], "left_semi").count() == 0
    assert recs.groupBy("user_id").agg(F.countDistinct("item_id").alias("n")).where("n != 8").count() == 0
    truth = held.join(seen, ["user_id", "item_id"], "left_anti")
    mine = M.recall_summary(M.recall_at_k(recs, truth, 8)).first()["avg_hit_proportion"]
    popular = seen.groupBy("item_id").count().orderBy(F.desc("count"), "item_id").limit(20).select("item_id")
    baseline = truth.join(popular, "item_id", "left_semi").count() / truth.count() * 8 / 20
    assert mine > 0.8 > baseline
    again = als_recommend(als_fit(seen, rank=8, max_iter=8, blocks=2), seen, 8)
    assert again.select("user_id", "item_id", "rank").exceptAll(recs.select("user_id", "item_id", "rank")).count() == 0
    asked = spark.createDataFrame([("u1",), ("stranger",)], "user_id string")
    assert [r[0] for r in unknown_users(fitted, asked).collect()] == ["stranger"]
    assert {r[0] for r in als_recommend(fitted, seen, 3, asked).select("user_id").collect()} == {"u1"}


def test_ranker_learns_the_order(spark):
    rng = random.Random(2)
    items = spark.createDataFrame([(f"i{n}", float(n % 5), n) for n in range(50)], "item_id string, aver_rate double, review_nums int")
    nutrients = spark.createDataFrame([(f"i{n}",) for n in range(50)], "item_id string")
    from gustara.operators.features import ITEM_NUTRIENTS

    nutrients = nutrients.withColumns({k: F.lit(1.0) for k in ITEM_NUTRIENTS})
    rows = [(f"u{u}", f"i{n}", float(n % 5) + 1, START) for u in range(20) for n in rng.sample(range(50), 15)]
    ratings = spark.createDataFrame(rows, ROWS)
    aged = WT.rating_with_age(ratings)
    matrix = ranking_matrix(user_features(ratings), item_features(items, nutrients), aged)
    assert matrix.count() == 300
    ranker = rank_model(matrix, max_iter=5, max_depth=3)
    scored = score(ranker, matrix).cache()
    assert M.graded_ndcg_at_k(scored, k=5).agg(F.avg("ndcg")).first()[0] > 0.95
    order = importance_order(ranker, spark).orderBy("position").collect()
    assert order[0]["feature_name"] == "aver_rate" and len(order) == len(ranker.features)
    titled = items.withColumn("title", F.col("item_id"))
    assert rank_items(scored, titled).where("score_rank = 1").select("user_id").distinct().count() == 20
    require_same_users(ratings, ratings)
    with pytest.raises(ValueError, match="different number"):
        require_same_users(ratings, ratings.where("user_id = 'u1'"))


def test_review_places_ties_by_date_and_carries_profiles(spark):
    scored = spark.createDataFrame(
        [("u", "a", 1.0, 1.0, 0.5), ("u", "b", 2.0, 2.0, 0.5), ("u", "c", 3.0, 2.0, 0.5), ("u", "d", 4.0, 0.0, 0.9), ("v", "a", 1.0, 1.0, 0.1)], SCORED
    )
    history = spark.createDataFrame([("u", 1, "z", 5.0), ("u", 2, "a", 4.0)], "user_id string, rank int, item_id string, rating double")
    titles = spark.createDataFrame([("a", "A"), ("d", None)], "item_id string, title string")
    of_items = spark.createDataFrame([("a", "pa"), ("z", "pz")], "item_id string, item_profile_text string")
    of_users = spark.createDataFrame([("u", "pu")], "user_id string, user_profile_text string")
    got = review_rows(scored, history, titles, of_items, of_users).orderBy("user_id", "part", "position").collect()
    assert [(r["user_id"], r["part"], r["position"], r["item_id"]) for r in got] == [
        ("u", "history", 1, "z"), ("u", "history", 2, "a"),
        ("u", "prediction", 1, "d"), ("u", "prediction", 2, "b"), ("u", "prediction", 3, "c"), ("u", "prediction", 4, "a"),
        ("v", "prediction", 1, "a"),
    ]
    assert [r["item_profile_text"] for r in got] == ["pz", "pa", None, None, None, "pa", "pa"]
    assert [r["user_profile_text"] for r in got] == ["pu"] * 6 + [None] and got[1]["title"] == "A"
