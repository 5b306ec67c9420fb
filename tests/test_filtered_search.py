"""Nearest neighbours under one filter per query, against brute force."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException

from gustara.operators.filtered_search import _block_search, filtered_search

BASE = "item_id string, embedding array<double>, kind string, size int, filters string"
QUERIES = "user_id string, embedding array<double>, filters map<string, array<string>>"


def _tables(spark):
    rng = np.random.default_rng(8)
    base = [(f"i{i}", rng.integers(-2, 3, 4).astype(float).tolist(), (None, "a", "b", 'c"\n')[i % 4], i % 3, "given") for i in range(120)]
    base += [("none", None, "a", 0, ""), ("zero", [0.0] * 4, "a", 0, "")]
    wanted = [None, {}, {"kind": ["a"]}, {"kind": ["a", 'c"\n'], "size": ["1"]}, {"size": []}, {"kind": [None, "zz"]}, {"kind": None}]
    queries = [(f"u{i}", rng.integers(-2, 3, 4).astype(float).tolist(), wanted[i % 7]) for i in range(70)]
    return spark.createDataFrame(base, BASE), spark.createDataFrame(queries, QUERIES), base, queries


@pytest.mark.parametrize("distance", ["COSINE", "EUCLIDEAN", "DOT_PRODUCT"])
def test_mixed_filters_match_brute_force(spark, distance):
    left, right, base, queries = _tables(spark)
    found = filtered_search(left, right, ["kind", "size"], k=7, distance=distance, block_bytes=1000)
    got = {}
    for r in found.collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["item_id"], pytest.approx(r["distance"], abs=1e-9)))
    for name, vector, wanted in queries:
        rows = []
        for item, other, kind, size, _ in base:
            holds = {"kind": kind, "size": str(size)}
            if other is None or not any(other) or not any(vector):
                continue
            if all(holds[a] is not None and holds[a] in (v or []) for a, v in (wanted or {}).items()):
                x, y = np.array(vector), np.array(other)
                d = {"EUCLIDEAN": np.linalg.norm(x - y), "DOT_PRODUCT": -(x @ y), "COSINE": 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y)}
                rows.append((round(d[distance], 9) + 0.0, item))
        want = [(i + 1, item, d) for i, (d, item) in enumerate(sorted(rows)[:7])]
        assert sorted(got.get(name, []), key=lambda t: t[0]) == want


def test_unknown_attribute_and_empty_sides(spark):
    left, right, _, _ = _tables(spark)
    assert filtered_search(left.where("false"), right, ["kind", "size"]).collect() == []
    assert filtered_search(left, right.where("false"), ["kind", "size"]).collect() == []
    with pytest.raises(PythonException, match="unknown attributes"):
        filtered_search(left, right, ["kind"]).collect()


def test_memory_of_a_block_does_not_grow_with_the_queries():
    """Distances are held a bounded number at a time, whatever the number of queries with one filter."""
    rng, n = np.random.default_rng(2), 20_000
    ids = pa.array([f"{i:06d}" for i in range(n)])
    held = pa.array([["a"]] * n)
    right = pa.table({"id": ids, "vec": pa.array(list(rng.normal(size=(n, 4)))), "held": held})
    left = right.slice(0, 2000).drop(["held"]).append_column("filter", pa.array(["{}"] * 2000))
    tracemalloc.start()
    found = _block_search(["kind"], 5, "COSINE")(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 10_000 and peak < 100 << 20
