"""Ball k-means codes against plain k-means over Python integers, and odd tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gustara.llm import ball_kmeans
from gustara.llm.common import prepare


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def brute_force(rows, parts, entries, rounds, scale=1024):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v in kept]
    books = [[cut[n][p] for n in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), n) for n, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for row in cut:
                groups.setdefault(nearest(row[p], books[p])[1], []).append(row[p])
            books[p] = [
                tuple(sum(column) // len(groups[n]) for column in zip(*groups[n])) if n in groups else entry
                for n, entry in enumerate(books[p])
            ]
    out = []
    for (i, _), row in zip(kept, cut):
        found = [nearest(row[p], books[p]) for p in range(parts)]
        out.append((i, tuple(n for _, n in found), sum(d for d, _ in found)))
    return out, [v for book in books for entry in book for v in entry]


def compare(session, rows, parts, entries, rounds):
    given = session.createDataFrame(
        [(i, v, n % 3 if n % 4 else None, "x", 1) for n, (i, v) in enumerate(rows)],
        "vec_id bigint, embedding array<float>, label int, kind string, codes int",
    )
    coded, books = ball_kmeans.compress_vectors(given, parts=parts, entries=entries, rounds=rounds)
    want, numbers = brute_force(rows, parts, entries, rounds)
    got = [(r["id"], tuple(r["codes"]), r["error"]) for r in coded.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and books.numbers() == numbers
    restored = {r["id"]: r["vector"] for r in ball_kmeans.restore(coded, books).collect()}
    assert all(len(v) == len(rows[0][1]) for v in restored.values())


def test_same_codes_and_books_as_plain_kmeans(session):
    draw = random.Random(3)
    centres = [[draw.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    near = [(n, [c + draw.gauss(0, 0.02) for c in draw.choice(centres)]) for n in range(300)]
    compare(session, near, 2, 16, 4)
    spread = [(n * 7 % 101, [draw.uniform(-2, 2) for _ in range(8)]) for n in range(101)]
    compare(session, spread, 4, 32, 3)


def test_ties_equal_vectors_repeated_and_null_ids(session):
    grid = [(n, [float(n % 3) / 1024, float(n % 2) / 1024]) for n in range(40)]  # many equal entries and equal distances
    odd = [(None, [0.5, -0.5]), (3, [0.25, 0.25]), (3, [0.0, 0.0]), (50, None), (51, [None, 1.0]), (52, [float("nan"), 0.0])]
    odd += [(53, [float("inf"), 0.0]), (54, []), (55, [-0.0001, -1e-9])]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in grid + odd]
    compare(session, rows, 2, 8, 4)
    compare(session, rows[:3], 1, 256, 2)


def test_search_from_a_ball_is_the_full_search():
    draw = np.random.default_rng(1)
    entries = draw.integers(-40, 40, (60, 3))
    entries[10:14] = entries[3]
    balls = ball_kmeans.Balls(entries)
    rows = draw.integers(-50, 50, (4000, 3)).astype(float)
    codes, dist = balls.search(rows)
    again, same = balls.reassign(rows, draw.integers(0, 60, 4000))
    assert (codes == again).all() and (dist == same).all()


def test_empty_and_impossible_tables(session):
    kind = "vec_id bigint, embedding array<double>, label string"
    coded, books = ball_kmeans.compress_vectors(session.createDataFrame([], kind))
    assert coded.count() == 0 and books.numbers() == []
    with pytest.raises(ValueError, match="equal parts"):
        ball_kmeans.compress_vectors(session.createDataFrame([(1, [1.0, 2.0, 3.0], "a")], kind))
    with pytest.raises(ValueError, match="too large"):
        ball_kmeans.compress_vectors(session.createDataFrame([(1, [1e12] * 4, "a")], kind))
