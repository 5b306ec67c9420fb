"""The pruning index against brute force, and how many block pairs it forms."""

from __future__ import annotations

import numpy as np
import pytest

from gustara.operators.vector_index import build_index, search_index

RNG = np.random.default_rng(11)
CENTRES = RNG.normal(size=(12, 6)) * 4
BASE = {f"i{n:03d}": CENTRES[n % 12] + RNG.normal(size=6) * 0.1 for n in range(400)}
BASE["i007"] = BASE["i019"].copy()  # ties
BASE["i031"] = BASE["i019"].copy()
QUERY = {f"q{n:02d}": CENTRES[n % 12] + RNG.normal(size=6) * 0.15 for n in range(40)}
QUERY["far"] = CENTRES[0] * -9.0
QUERY["same"] = BASE["i019"].copy()


def frame(spark, vectors, name):
    rows = [(k, [float(x) for x in v], "x", 1) for k, v in vectors.items()]
    rows += [("empty", [], "x", 1), ("zero", [0.0] * 6, "x", 1), ("null", None, "x", 1), ("nan", [float("nan")] * 6, "x", 1)]
    return spark.createDataFrame(rows, f"{name} string, embedding array<double>, block string, away int")


def distance(a, b, kind):
    if kind == "COSINE":
        return 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    return -(a @ b) if kind == "DOT_PRODUCT" else float(np.linalg.norm(a - b))


def key(value, kind):
    """Distances equal to nine digits are ties: decimals for the cosine, significant digits otherwise."""
    return round(value, 9) + 0.0 if kind == "COSINE" else float(f"{value:.8e}")


def check(found, k, kind, exclude=frozenset()):
    got = {}
    for row in found.orderBy("user_id", "rank").collect():
        got.setdefault(row["user_id"], []).append(row["item_id"])
    for q, v in QUERY.items():
        want = sorted((key(distance(v, b, kind), kind), i) for i, b in BASE.items() if (q, i) not in exclude)[:k]
        assert got[q] == [i for _, i in want], q
    assert set(got) == set(QUERY)


@pytest.mark.parametrize("kind", ["COSINE", "DOT_PRODUCT", "EUCLIDEAN"])
def test_same_rows_with_fewer_block_pairs(spark, kind):
    index = build_index(frame(spark, BASE, "item_id"), kind, block_rows=16)
    counts = {}
    found = search_index(index, frame(spark, QUERY, "user_id"), 5, block_rows=4, counts=counts)
    check(found, 5, kind)
    assert 0 < counts["formed"] < counts["pairs"]
    if kind != "DOT_PRODUCT":  # lengths that differ much leave the inner product loose bounds
        assert counts["formed"] < counts["pairs"] / 2


def test_exclusions_and_lists_longer_than_the_base(spark):
    index = build_index(frame(spark, BASE, "item_id"), block_rows=16)
    excluded = {(q, i) for q in list(QUERY)[:6] for i in list(BASE)[:300]} | {("same", "i019")}
    pairs = spark.createDataFrame(sorted(excluded) * 2 + [("q00", "unknown"), ("nobody", "i001")], "user_id string, item_id string")
    check(search_index(index, frame(spark, QUERY, "user_id"), 20, exclude=pairs, block_rows=4), 20, "COSINE", excluded)
    check(search_index(index, frame(spark, QUERY, "user_id"), 500), 500, "COSINE")


def test_empty_sides_one_hot_vector_and_wrong_lengths(spark):
    kind = "{} string, embedding array<double>"
    none = spark.createDataFrame([], kind.format("item_id"))
    asked = spark.createDataFrame([("q", [1.0, 0.0])], kind.format("user_id"))
    assert search_index(build_index(none), asked).count() == 0
    hot = spark.createDataFrame([(f"{n:03d}", [1.0, 1.0]) for n in range(100)] + [("x", [1.0, 0.0])], kind.format("item_id"))
    index = build_index(hot, "EUCLIDEAN", block_rows=8)
    assert search_index(index, asked.limit(0)).count() == 0
    assert index.blocks.agg({"n": "max"}).first()[0] <= 8
    assert [r["item_id"] for r in search_index(index, asked, 3, block_rows=8).orderBy("rank").collect()] == ["x", "000", "001"]
    wrong = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], kind.format("user_id"))
    with pytest.raises(Exception, match="cannot be compared"):
        search_index(index, wrong).count()
    with pytest.raises(ValueError, match="distance"):
        build_index(none, "MANHATTAN")
