"""Lambda gradients against all pairs, histograms against row sums, the listwise fit against the pointwise one."""

from __future__ import annotations

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from gustara.operators import listwise
from gustara.operators.listwise import Tree, _histograms, _pulled, _unpacked, fit_listwise, lambda_gradients, score_listwise
from gustara.operators.metrics import graded_ndcg_at_k
from gustara.operators.ranker import importance_order, rank_model, score
from gustara.plans import q_models

K = 5


def all_pairs(gain, score, order):
    """Gradients of NDCG@K of one user, pair by pair; ``order`` lists the rows by score."""
    n, place = len(gain), {row: p for p, row in enumerate(order)}
    discount = [1 / np.log2(place[i] + 2) if place[i] < K else 0.0 for i in range(n)]
    ideal = sum(g / np.log2(p + 2) for p, g in enumerate(sorted(gain, reverse=True)[:K]))
    g, h = np.zeros(n), np.zeros(n)
    for i in range(n):
        for j in range(n):
            if gain[i] > gain[j] and ideal > 0:
                change = (gain[i] - gain[j]) * abs(discount[i] - discount[j]) / ideal
                wrong = 1 / (1 + np.exp(score[i] - score[j]))
                g[i] -= wrong * change
                g[j] += wrong * change
                h[i] += wrong * (1 - wrong) * change
                h[j] += wrong * (1 - wrong) * change
    return g, h


def test_gradients_are_those_of_all_pairs(spark):
    draw = random.Random(1)
    sizes = {"a": 40, "b": 3, "c": 1, "flat": 6, "none": 4}
    rows = []
    for user, n in sizes.items():
        for i in range(n):
            gain = {"flat": 3.0, "none": 0.0}.get(user, float(2 ** draw.randint(0, 5) - 1))
            rows.append((user, len(rows), gain, draw.choice([0.0, 0.5, draw.gauss(0, 1)]), bytes([i])))
    state = spark.createDataFrame(rows, "user_id string, rid bigint, gain double, score double, bins binary").repartition(3)
    ideal = [(u, float(sum(g / np.log2(p + 2) for p, g in enumerate(sorted((r[2] for r in rows if r[0] == u), reverse=True)[:K])))) for u in sizes]
    pulled = _pulled(state, spark.createDataFrame(ideal, "user_id string, ideal double"), K).collect()
    assert sum(r["own"] for r in pulled) == len(rows)
    found, bins = {}, {r[1]: r[4] for r in rows}
    for r in pulled:
        g, h = found.get(r["rid"], (0.0, 0.0))
        found[r["rid"]] = g + r["g"], h + r["h"]
        assert bytes(r["bins"]) == bins[r["rid"]]
    for user in sizes:
        mine = [r for r in rows if r[0] == user]
        order = sorted(range(len(mine)), key=lambda i: (-mine[i][3], mine[i][1]))
        g, h = all_pairs([r[2] for r in mine], [r[3] for r in mine], order)
        assert np.allclose([found[r[1]] for r in mine], np.column_stack([g, h]))


def test_histograms_are_sums_of_rows(spark):
    draw = np.random.default_rng(0)
    bins = draw.integers(0, 65, (200, 3)).astype(np.uint8)
    g, h = draw.normal(size=200), draw.random(200)
    tree = Tree(2)
    tree.feature[0], tree.cut[0] = 1, 30
    df = spark.createDataFrame([(b.tobytes(), float(x), float(y)) for b, x, y in zip(bins, g, h)], "bins binary, g double, h double")
    got = _histograms(df.repartition(3), tree, np.array([1, 2]), 3)
    for node, rows in ((0, bins[:, 1] <= 30), (1, bins[:, 1] > 30)):
        for f in range(3):
            for b in range(65):
                there = rows & (bins[:, f] == b)
                assert np.allclose(got[node, f, b], [g[there].sum(), h[there].sum()])


def planted(spark):
    """``loud`` tells low labels apart, ``fine`` the few high ones that decide the head of a list."""
    draw, rows = random.Random(6), []
    for u in range(40):
        for i in range(30):
            high, loud, fine = i < 4, draw.random(), draw.random()
            label = (5.0 if fine > 0.5 else 3.0) if high else (2.5 if loud > 0.5 else 0.0)
            rows.append((f"u{u}", f"i{i}", label, label, loud, fine, float(high) + draw.gauss(0, 0.6)))
    return spark.createDataFrame(rows, "user_id string, item_id string, rating double, rating_date double, loud double, fine double, hint double")


def test_listwise_trees_beat_pointwise_ones_at_the_head(spark):
    matrix = planted(spark).cache()
    listwise = fit_listwise(matrix, rounds=6, max_depth=1, step=0.3)
    pointwise = rank_model(matrix, max_iter=6, max_depth=1, step=0.3)

    def ndcg(scored):
        graded = scored.withColumn("rating", (2.0 ** scored["rating"]) - 1.0)
        return graded_ndcg_at_k(graded, k=5).agg({"ndcg": "avg"}).first()[0]

    ours, theirs = ndcg(score_listwise(listwise, matrix)), ndcg(score(pointwise, matrix))
    assert ours > theirs + 0.01, (ours, theirs)
    order = importance_order(listwise, spark).orderBy("position").collect()
    assert abs(sum(r["feature_importance"] for r in order) - 1) < 1e-9 and len(order) == 3
    again = fit_listwise(matrix.repartition(5), rounds=2, max_depth=1, step=0.3)
    for one, two in zip(listwise.trees, again.trees):
        assert (one.feature == two.feature).all() and (one.cut == two.cut).all() and np.allclose(one.value, two.value)


def test_repeats_nulls_and_empty_matrices(spark):
    kind = "user_id string, item_id string, rating double, rating_date double, x double"
    rows = [("u", "i", 1.0, 1.0, None)] * 3 + [("u", "j", 5.0, 5.0, float("nan")), (None, "k", 1.0, 1.0, 1.0), ("v", "k", None, 1.0, 1.0)]
    ranker = fit_listwise(spark.createDataFrame(rows, kind), rounds=2, max_depth=2)
    assert ranker.trees == [] and score_listwise(ranker, spark.createDataFrame(rows, kind)).count() == 6
    empty = fit_listwise(spark.createDataFrame([], kind), rounds=2)
    assert empty.trees == [] and empty.importances() == [0.0]


def test_gradients_without_first_rows():
    none = np.full((2, K), np.nan)
    out = lambda_gradients(np.array([1.0, 3.0]), np.zeros(2), np.array([-1, -1]), none, none, np.array([0.0, 1.0]))
    assert all((x == 0).all() for x in out)


def test_bins_are_read_in_place():
    """No Python object per row; slices of a batch start where they start."""
    bins = np.random.default_rng(3).integers(0, 65, (100_000, 5)).astype(np.uint8)
    column = pa.array([b.tobytes() for b in bins], pa.binary())
    tracemalloc.start()
    whole, some = _unpacked(column), _unpacked(column.slice(7, 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (whole == bins).all() and (some == bins[7:27]).all() and peak < 1 << 20


def test_tasks_that_keep_their_rows_grow_the_trees_of_jobs(spark, monkeypatch):
    """With one task, and with three that share out a user with most of the rows."""
    draw, rows = random.Random(11), []
    for user, n in {"hot": 300, "a": 40, "b": 3, "c": 1, "flat": 6, **{f"u{i}": 12 for i in range(12)}}.items():
        for i in range(n):
            x, y = draw.randint(0, 9), draw.choice([None, 0.5, draw.random()])
            label = 2.0 if user == "flat" else float(draw.randint(0, 2) + (x > 6) + (y is None))
            rows.append((user, f"i{i}", label, label, x, y, 3.0))
    matrix = spark.createDataFrame(rows, "user_id string, item_id string, rating double, rating_date double, x int, y double, same double").cache()
    fits = {}
    for tasks in (0, 1, 3):
        monkeypatch.setattr(listwise, "_tasks", lambda state: tasks)
        fits[tasks] = fit_listwise(matrix, rounds=4, max_depth=3, step=0.3)
    by_jobs = fits[0]
    assert len(by_jobs.trees) == 4
    for tasks in (1, 3):
        for one, two in zip(by_jobs.trees, fits[tasks].trees, strict=True):
            assert (one.feature == two.feature).all() and (one.cut == two.cut).all() and np.allclose(one.value, two.value)
        assert np.allclose(by_jobs.gains, fits[tasks].gains)
    bins = np.random.default_rng(5).integers(0, 65, (1000, 3)).astype(np.uint8)
    assert np.allclose(by_jobs.score(bins), sum(0.3 * t.value[t.node(bins)] for t in by_jobs.trees))


def test_registered_ranker_has_all_trees_of_the_surveyed_model(monkeypatch):
    split = SimpleNamespace(train=None, valid=None)
    monkeypatch.setattr(q_models, "stored_split", lambda spark, sf: split)
    for name in ("user_features", "product_rows", "rating_with_age", "ranking_matrix", "materialize"):
        monkeypatch.setattr(q_models, name, lambda *given: None)
    monkeypatch.setattr(q_models, "fit_listwise", lambda matrix, **given: given)
    asked = q_models.fitted_ranker(None, "")[-1]
    assert (asked["rounds"], asked["max_depth"], asked["step"]) == (500, 8, 0.05)
