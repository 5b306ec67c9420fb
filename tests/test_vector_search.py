"""Block search against brute force."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gustara.operators import hyde
from gustara.operators import vector_search as vector_module
from gustara.operators.hyde import semantic_search, text_match
from gustara.operators.vector_search import _block_search, search_matches, search_repeated, vector_search
from gustara.providers.offline import HashingProvider

RNG = np.random.default_rng(5)
BASE = {f"i{i}": RNG.normal(size=8) for i in range(120)}
BASE["i5"] = BASE["i50"].copy()  # ties
QUERY = {f"q{i}": RNG.normal(size=8) for i in range(30)}


def frame(spark, vectors, name):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], f"{name} string, embedding array<double>")


def distance(a, b, kind):
    if kind == "COSINE":
        return 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    return -(a @ b) if kind == "DOT_PRODUCT" else float(np.linalg.norm(a - b))


def brute(k, kind, exclude=frozenset()):
    return {
        q: sorted(((round(distance(v, b, kind), 9), i) for i, b in BASE.items() if (q, i) not in exclude))[:k]
        for q, v in QUERY.items()
    }


def collected(df):
    got = {}
    for r in df.orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append((round(r["distance"], 9), r["item_id"]))
    return got


@pytest.mark.parametrize("kind", ["COSINE", "DOT_PRODUCT", "EUCLIDEAN"])
@pytest.mark.parametrize("block_bytes", [64 << 20, 64 * 8 * 7])
def test_matches_brute_force(spark, kind, block_bytes):
    found = vector_search(frame(spark, BASE, "item_id"), frame(spark, QUERY, "user_id"), 10, kind, block_bytes=block_bytes)
    got, want = collected(found), brute(10, kind)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    for q in want:
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]], abs=1e-9)


@pytest.mark.parametrize("block_bytes", [64 << 20, 64 * 8 * 7])
def test_exclusions_never_leak_and_leave_k(spark, block_bytes):
    excluded = {(q, i) for q in list(QUERY)[:10] for i in list(BASE)[:100]}
    pairs = spark.createDataFrame(sorted(excluded) + [("q0", "unknown"), ("nobody", "i1")], "user_id string, item_id string")
    found = vector_search(
        frame(spark, BASE, "item_id"), frame(spark, QUERY, "user_id"), 20, exclude=pairs, block_bytes=block_bytes
    )
    got = collected(found)
    assert {q: [i for _, i in v] for q, v in got.items()} == {
        q: [i for _, i in v] for q, v in brute(20, "COSINE", excluded).items()
    }
    assert all(len(v) == 20 for v in got.values())


def test_exclusions_of_a_block_stay_arrow_columns():
    """Many exclusions cost some bytes each, not Python objects; the last of equal ids is the one left out."""
    rng, pairs = np.random.default_rng(4), 300_000
    right = pa.table({"id": [f"i{i}" for i in range(600)] + ["i0"], "vec": pa.array(list(rng.normal(size=(601, 4))))})
    names = pa.array([f"q{i}" for i in range(100)])
    vectors = pa.table({"id": names, "excluded": pa.nulls(100, pa.string()), "vec": right.column("vec").slice(0, 100)})
    at = np.arange(pairs)
    gone = {"id": names.take(pa.array(at // 500 % 100)), "excluded": right.column("id").combine_chunks().take(pa.array(at % 500))}
    left = pa.concat_tables([vectors, pa.table({**gone, "vec": pa.nulls(pairs, pa.list_(pa.float64()))})])
    tracemalloc.start()
    found = _block_search(101, "COSINE")(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    listed = zip(found.column("query").to_pylist(), found.column("base").to_pylist(), strict=True)
    assert {i for q, i in listed if q == "q7"} == {"i0", *(f"i{i}" for i in range(500, 600))}
    assert peak < 30 << 20, peak


def test_a_full_cell_holds_no_second_copy_of_its_rows():
    """Single-precision base vectors stay as stored, excluded pairs are looked up in pieces, few columns reach the short list."""
    rng, n, pairs = np.random.default_rng(6), 60_000, 600_000
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=n * 64).astype(np.float32)), 64).cast(pa.list_(pa.float32()))
    right = pa.table({"id": [f"i{i}" for i in range(n)], "vec": vectors})
    names = pa.array([f"q{i}" for i in range(100)])
    asked = pa.table({"id": names, "excluded": pa.nulls(100, pa.string()), "vec": right.column("vec").slice(0, 100)})
    at = np.arange(pairs)
    gone = {"id": names.take(pa.array(at % 100)), "excluded": right.column("id").combine_chunks().take(pa.array(at // 100 * 7))}
    left = pa.concat_tables([asked, pa.table({**gone, "vec": pa.nulls(pairs, vectors.type)})])
    tracemalloc.start()
    found = _block_search(20, "COSINE")(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 2000
    mine = {q: i for q, i, d in zip(*found.select(["query", "base", "distance"]).to_pydict().values(), strict=True) if d < 1e-6}
    assert mine == {f"q{i}": f"i{i}" for i in range(100) if i % 7}  # q0, q7, ... leave themselves out
    assert peak < 70 << 20, peak


def test_every_parallel_task_has_some_blocks(spark):
    """One block more than tasks would leave all but one of them idle half of the time."""
    left, right = spark.range(4096 * 40), spark.range(10)
    grid = vector_module.BlockGrid.of(left, right, F.lit(512))
    assert (grid.n_left, grid.n_right) == (3 * spark.sparkContext.defaultParallelism, 1)
    assert vector_module.BlockGrid.of(spark.range(4097), right, F.lit(512)).n_left == 2


@pytest.mark.parametrize("kind", ["COSINE", "DOT_PRODUCT", "EUCLIDEAN"])
@pytest.mark.parametrize("n", [639, 640, 1000, 2048])
def test_short_list_of_groups_and_the_rest_of_the_columns(kind, n):
    """Block widths on both sides of k groups, with and without columns left over; a query may lose all but two rows."""
    rng = np.random.default_rng(n)
    base, query = rng.normal(size=(n, 8)).astype(np.float32), rng.normal(size=(9, 8)).astype(np.float32)
    base[n // 2 :: 3] = base[0]
    ids = [f"b{i:04d}" for i in rng.permutation(n)]
    excluded = [("q0", i) for i in ids[2:]] + [("q1", i) for i in ids[::2]]
    kind_of = pa.list_(pa.float32())
    asked = pa.table({"id": [f"q{i}" for i in range(9)], "excluded": pa.nulls(9, pa.string()), "vec": pa.array(list(query), kind_of)})
    gone = pa.table({"id": [q for q, _ in excluded], "excluded": [i for _, i in excluded], "vec": pa.nulls(len(excluded), kind_of)})
    found = _block_search(20, kind)(pa.concat_tables([gone, asked]), pa.table({"id": ids, "vec": pa.array(list(base), kind_of)}))
    got = {}
    for q, i in zip(found.column("query").to_pylist(), found.column("base").to_pylist(), strict=True):
        got.setdefault(q, []).append(i)
    for at, v in enumerate(query.astype(float)):
        rows = [(round(distance(v, b, kind), 9), i) for b, i in zip(base.astype(float), ids) if (f"q{at}", i) not in excluded]
        assert got[f"q{at}"] == [i for _, i in sorted(rows)[:20]]


@pytest.mark.parametrize("kind", ["COSINE", "DOT_PRODUCT", "EUCLIDEAN"])
def test_repeated_vectors_give_the_rows_of_the_plain_search(spark, kind):
    """Copies on both sides, ties between classes, repeated ids, more copies than k."""
    few = [v for v in list(BASE.values())[:6]] + [2.0 * BASE["i0"]]
    base = [(f"b{i % 70}", [float(x) for x in few[i % 7]]) for i in range(100)]
    query = [(f"q{i % 25}", [float(x) for x in few[i % 4]]) for i in range(30)]
    frames = spark.createDataFrame(base, "item_id string, embedding array<double>"), spark.createDataFrame(query, "user_id string, embedding array<double>")
    plain, classes = (
        sorted((r["user_id"], r["rank"], r["item_id"], round(r["distance"], 9)) for r in f(*frames, 20, kind).collect()) for f in (vector_search, search_repeated)
    )
    assert plain == classes


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    met = []
    monkeypatch.setattr(hyde, "embed_text", lambda rows, *a: rows.withColumn("embedding", F.array(F.lit(1.0), F.length("hyde_profile_text") * 1.0)))
    monkeypatch.setattr(hyde, "generate", lambda rows, *a: rows.select("user_id", F.lit("x").alias("full_response"), F.col("user_profile_text").alias("answer_text")))
    grid = vector_module.BlockGrid.of
    monkeypatch.setattr(vector_module.BlockGrid, "of", staticmethod(lambda q, b, *a: met.append((q.count(), b.count())) or grid(q, b, *a)))
    users = spark.createDataFrame([(f"u{i}", "ab" * (i % 2)) for i in range(40)], "user_id string, user_profile_text string")
    base = spark.createDataFrame([(f"i{i}", [1.0, float(i % 3)]) for i in range(60)], "item_id string, embedding array<double>")
    found = hyde.hyde_search(users, base, "", None, None, 20)
    assert found.count() == 800 and met == [(2, 3)]


def test_fewer_candidates_than_k(spark):
    few = dict(list(BASE.items())[:3])
    found = vector_search(frame(spark, few, "item_id"), frame(spark, QUERY, "user_id"), 20)
    assert found.groupBy("user_id").count().where("count != 3").count() == 0


def test_invalid_vectors_are_left_out(spark):
    base = spark.createDataFrame([("a", [1.0, 0.0]), ("b", []), ("c", None), ("d", [0.0, 0.0])], "item_id string, embedding array<double>")
    query = spark.createDataFrame([("q", [1.0, 1.0]), ("z", [0.0, 0.0])], "user_id string, embedding array<double>")
    assert [(r["user_id"], r["item_id"]) for r in vector_search(base, query, 5).collect()] == [("q", "a")]


def test_single_precision_input(spark):
    base = frame(spark, BASE, "item_id").withColumn("embedding", F.col("embedding").cast("array<float>"))
    query = frame(spark, QUERY, "user_id").withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert vector_search(base, query, 4).count() == 120


def test_no_rows(spark):
    empty = frame(spark, {"a": [1.0]}, "item_id").where("false")
    assert vector_search(empty, frame(spark, QUERY, "user_id"), 5).count() == 0


def test_dimensions_must_agree(spark):
    base = spark.createDataFrame([("a", [1.0, 0.0, 2.0])], "item_id string, embedding array<double>")
    with pytest.raises(Exception, match="dimensions"):
        vector_search(base, frame(spark, QUERY, "user_id"), 5).count()
    with pytest.raises(ValueError, match="distance"):
        vector_search(base, base, 5, "MANHATTAN")


def test_matches_carry_both_rows(spark):
    base, query = frame(spark, BASE, "item_id"), frame(spark, QUERY, "user_id")
    row = search_matches(vector_search(base, query, 1), query, base).first()
    assert len(row["query"]["embedding"]) == len(row["base"]["embedding"]) == 8


DOCS = {"d1": "red soup with basil", "d2": "Blue cake", "d3": "red soup", "d4": "a long story about RED SOUP again"}


def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "item_id string, content string")


def test_text_match(spark, rows):
    queries = spark.createDataFrame([("q1", "Red soup"), ("q2", "cake "), ("q3", "tea"), ("q4", " "), ("q5", None)], "query_id string, text string")
    assert rows(text_match(queries, docs(spark), 2)) == [("q1", "d1", 1), ("q1", "d3", 2), ("q2", "d2", 1)]


def test_text_match_finds_what_contains_finds(spark, rows):
    draw = random.Random(3)
    words = ["".join(draw.choice("abcAé.-") for _ in range(draw.randint(1, 5))) for _ in range(60)]
    texts = [draw.choice([" ", "  ", "\n"]).join(draw.choice(words) for _ in range(draw.randint(1, 40))) for _ in range(80)]
    base = [(f"d{n:02d}", t, "x") for n, t in enumerate(texts)] + [("d00", texts[0], "x"), ("none", None, "x"), ("empty", "", "x")]
    needles = ["a", "é", "-", "ab", "zzzz", "not in any", "\n", ""]
    for _ in range(60):
        text = draw.choice(texts)
        start = draw.randint(0, len(text) - 1)
        needles.append(text[start : start + draw.choice([1, 2, 4, 9, 25, 200])].swapcase())  # cuts words anywhere
    queries = spark.createDataFrame([(f"q{n:02d}", t, 1) for n, t in enumerate(needles)] + [("q10", needles[10], 1)], "query_id string, text string, n int")
    got = rows(text_match(queries, spark.createDataFrame(base, "item_id string, content string, token string"), 5))
    want = []
    for n, needle in enumerate(needles):
        needle = needle.strip(" ").lower()
        hits = sorted({i for i, t, _ in base if t is not None and needle in t.lower()}) if needle.strip() else []
        want += [(f"q{n:02d}", i, r + 1) for r, i in enumerate(hits[:5])]
    assert got == sorted(want, key=repr)
    empty = spark.createDataFrame([], "item_id string, content string")
    assert text_match(queries, empty).count() == 0 and text_match(queries.limit(0), docs(spark)).count() == 0


def test_semantic_search_falls_back_to_text(spark, rows):
    from gustara.operators.generate import embed_text

    base = embed_text(docs(spark), "content", HashingProvider(64)).withColumn("category", F.lit("c"))
    queries = spark.createDataFrame([("q1", "red soup"), ("q2", "story about")], "query_id string, text string")
    got = rows(semantic_search(queries, base, HashingProvider(64), 1, 0.01), "query_id", "item_id", "source")
    assert got == [("q1", "d3", "vector"), ("q2", "d4", "text")]
    assert semantic_search(queries, base, HashingProvider(64), 1, 0.01, "other").count() == 0


@pytest.mark.parametrize("kind", ["COSINE", "DOT_PRODUCT", "EUCLIDEAN"])
def test_a_third_of_the_base_is_one_vector(spark, kind):
    """Copies tie exactly: the k smallest ids among them win, in every block layout."""
    same = [float(x) for x in RNG.normal(size=8)]
    base = {f"b{i:03d}": (same if i % 3 == 0 else [float(x) for x in RNG.normal(size=8)]) for i in range(900)}
    query = {"near": same, "far": [-x for x in same]}
    excluded = spark.createDataFrame([("near", f"b{i:03d}") for i in range(0, 90, 3)] * 2, "user_id string, item_id string")
    for block_bytes in (64 << 20, 64 * 8 * 50):
        found = vector_search(
            frame(spark, base, "item_id"), frame(spark, query, "user_id"), 10, kind, exclude=excluded, block_bytes=block_bytes
        )
        got = collected(found)
        want = {
            q: sorted(
                (round(distance(np.array(v), np.array(b), kind), 9), i)
                for i, b in base.items()
                if not (q == "near" and int(i[1:]) < 90 and int(i[1:]) % 3 == 0)
            )[:10]
            for q, v in query.items()
        }
        assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


@pytest.mark.parametrize("kind", ["COSINE", "DOT_PRODUCT", "EUCLIDEAN"])
@pytest.mark.parametrize("spoilt", [float("nan"), float("inf"), None])
def test_one_spoilt_row_costs_only_itself(spark, kind, spoilt):
    good = [(f"b{i}", [float(i), 1.0, 2.0]) for i in range(1, 9)]
    bad = [("bad", [spoilt, 1.0, 2.0])]
    kinds = "item_id string, embedding array<double>"
    query = spark.createDataFrame([("q", [3.0, 1.0, 2.0]), ("worse", [1.0, spoilt, 0.0])], "user_id string, embedding array<double>")
    clean = vector_search(spark.createDataFrame(good, kinds), query, 3, kind).collect()
    mixed = vector_search(spark.createDataFrame(good + bad, kinds), query, 3, kind).collect()
    assert sorted(mixed) == sorted(clean) and len(clean) == 3


@pytest.mark.parametrize("kind", ["DOT_PRODUCT", "EUCLIDEAN"])
@pytest.mark.parametrize("scale", [1e-5, 1.0, 1e5])
def test_order_does_not_depend_on_the_vectors_length(spark, kind, scale):
    vectors = [(f"b{i}", [scale * ((i * 7) % 20 + 1), scale]) for i in range(20)]
    base = spark.createDataFrame(vectors, "item_id string, embedding array<double>")
    query = spark.createDataFrame([("q", [scale * 21, 0.0])], "user_id string, embedding array<double>")
    got = [r["item_id"] for r in vector_search(base, query, 5, kind).orderBy("rank").collect()]
    assert got == sorted(dict(vectors), key=lambda b: -dict(vectors)[b][0])[:5]
