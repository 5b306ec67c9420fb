"""Weighted normal equations against a dense numpy sweep, hot rows, fold-in, odd tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gustara.operators import weighted_als
from gustara.operators.weighted_als import fold_in, gram, start_factors, weighted_als_fit

DRAW = random.Random(2)
ROWS = [(f"u{DRAW.randint(0, 19):02d}", f"i{DRAW.randint(0, 29):02d}", DRAW.choice([1.0, 2.5, 5.0, 0.2, -1.0, 0.0])) for _ in range(300)]
ROWS += [("u00", f"i{n:02d}", 3.0) for n in range(30)]  # a user with every item
SCHEMA = "user_id string, item_id string, rating double"


def dense(rows):
    users, items = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    table = {}
    for u, i, v in rows:
        table[u, i] = table.get((u, i), 0.0) + v
    return users, items, table


def brute_solve(table, row_ids, factors, by_row, reg, alpha):
    side = len(next(iter(factors.values())))
    y = np.stack(list(factors.values()))
    out = {}
    for row in row_ids:
        left, right = y.T @ y + reg * np.eye(side), np.zeros(side)
        for (u, i), v in table.items():
            mine, other = (u, i) if by_row else (i, u)
            if mine == row and other in factors:
                c, f = alpha * v, factors[other]
                left = left + (abs(c) - 1) * np.outer(f, f)
                right = right + (c * f if c > 0 else 0)
        out[row] = np.linalg.solve(left, right)
    return out


def vectors(df, key):
    return {r[key]: np.array(r["embedding"]) for r in df.collect()}


@pytest.mark.parametrize("part_rows", [1 << 17, 4])
def test_one_sweep_is_the_dense_sweep(spark, part_rows):
    given = spark.createDataFrame([*ROWS, ("u01", None, 1.0), (None, "i01", 1.0), ("u02", "i02", None), ("u02", "i02", float("nan"))], SCHEMA)
    start = vectors(start_factors(spark.createDataFrame(ROWS, SCHEMA), 5, 0), "user_id")
    fitted = weighted_als_fit(given, rank=5, iterations=1, reg=0.05, alpha=2.0, part_rows=part_rows)
    users, items, table = dense(ROWS)
    assert sorted(start) == users
    want_items = brute_solve(table, items, start, False, 0.05, 2.0)
    want_users = brute_solve(table, users, want_items, True, 0.05, 2.0)
    for got, want in ((vectors(fitted.items, "item_id"), want_items), (vectors(fitted.users, "user_id"), want_users)):
        assert sorted(got) == sorted(want)
        assert max(np.abs(got[k] - want[k]).max() for k in want) < 1e-9


def test_fold_in_is_the_last_solve_of_the_fit(spark):
    given = spark.createDataFrame(ROWS, SCHEMA)
    fitted = weighted_als_fit(given, rank=4, iterations=3)
    known, again = vectors(fitted.users, "user_id"), vectors(fold_in(fitted, given), "user_id")
    assert sorted(known) == sorted(again) and max(np.abs(known[k] - again[k]).max() for k in known) < 1e-9
    fresh = [("new", "i01", 4.0), ("new", "i02", 2.0), ("new", "unknown", 5.0), ("stranger", "unknown", 5.0)]
    got = vectors(fold_in(fitted, spark.createDataFrame(fresh, SCHEMA), part_rows=1), "user_id")
    items = vectors(fitted.items, "item_id")
    want = brute_solve(dense(fresh)[2], ["new"], items, True, 0.05, 2.0)
    assert list(got) == ["new"] and np.abs(got["new"] - want["new"]).max() < 1e-9


def test_fit_brings_entries_closer_and_repeats_itself(spark):
    given = spark.createDataFrame([(f"u{n}", f"i{n % 2}{m}", 5.0) for n in range(12) for m in range(6) if (n + m) % 5], SCHEMA)
    fitted = weighted_als_fit(given, rank=4, iterations=8)
    users, items = vectors(fitted.users, "user_id"), vectors(fitted.items, "item_id")
    own = [users[f"u{n}"] @ items[f"i{n % 2}{m}"] for n in range(12) for m in range(6)]
    other = [users[f"u{n}"] @ items[f"i{(n + 1) % 2}{m}"] for n in range(12) for m in range(6)]
    assert np.mean(own) > 0.8 and abs(np.mean(other)) < 0.2
    again = vectors(weighted_als_fit(given.repartition(7), rank=4, iterations=8).users, "user_id")
    assert max(np.abs(users[k] - again[k]).max() for k in users) < 1e-6


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    fitted = weighted_als_fit(none, rank=3, iterations=1)
    assert fitted.users.count() == 0 and fitted.items.count() == 0 and gram(fitted.items) is None
    assert fold_in(fitted, spark.createDataFrame(ROWS[:3], SCHEMA)).count() == 0


def test_few_factors_meet_the_entries_after_the_shuffle(spark, monkeypatch):
    """Entries are dealt without factors where these are few; the factors are those of the other plan."""
    rows = [(f"u{i % 40}", f"i{i * 7 % 11}", 1.0 + i % 3) for i in range(300)]
    given = spark.createDataFrame(rows, "user_id string, item_id string, rating double")
    sent = []
    broadcast = weighted_als.F.broadcast
    monkeypatch.setattr(weighted_als.F, "broadcast", lambda side: sent.append(1) or broadcast(side))
    fits = []
    for few in (10_000, 11, 0):
        monkeypatch.setattr(weighted_als, "SMALL_SIDE", few)
        fitted = weighted_als.weighted_als_fit(given, rank=4, iterations=2, part_rows=16)
        fits.append({r["user_id"]: r["embedding"] for r in fitted.users.collect()})
        assert len(sent) == {10_000: 4, 11: 6, 0: 6}[few]
    for other in fits[1:]:
        assert other.keys() == fits[0].keys() and all(np.allclose(other[u], fits[0][u], rtol=1e-9, atol=1e-12) for u in other)
