"""Window split and histories against plain Python on a small skewed set."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gustara.operators import history as H
from gustara.operators import split as P
from gustara.operators.relational import DuplicateKeyError

START = dt.datetime(2024, 1, 1)


def make(seed, n, first_day, last_day):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        user = "hot" if rng.random() < 0.35 else f"u{rng.randrange(12)}"
        when = START + dt.timedelta(days=rng.uniform(first_day, last_day))
        rows.append((user, f"i{rng.randrange(15)}", float(rng.randrange(1, 6)), when))
    return rows


SCHEMA = "user_id string, item_id string, rating double, ts timestamp"
TRAIN, VALID = make(1, 300, 0, 60), make(2, 200, 60, 90)


def expected():
    newest, oldest = max(r[3] for r in TRAIN), min(r[3] for r in VALID)
    train = [r for r in TRAIN if r[3] >= newest - dt.timedelta(days=20)]
    valid = [r for r in VALID if r[3] <= oldest + dt.timedelta(days=10) and r[2] >= 3]
    users = {r[0] for r in train} & {r[0] for r in valid}
    items = {r[1] for r in train} & {r[1] for r in valid}
    train = [r for r in train if r[0] in users and r[1] in items]
    valid = [r for r in valid if r[0] in users and r[1] in items]

    def enough(part, m):
        return {u for u in users if sum(r[0] == u for r in part) >= m}

    final = enough(train, 5) & enough(valid, 3)
    return [r for r in train if r[0] in final], [r for r in valid if r[0] in final], final


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(TRAIN, SCHEMA), spark.createDataFrame(VALID, SCHEMA)


@pytest.mark.parametrize("store", [True, False])
def test_windowed_split(frames, rows, store):
    split = P.windowed_split(*frames, 20, 10, 3.0, 5, 3, store=store)
    train, valid, users = expected()
    assert rows(split.train, "user_id", "item_id", "rating", "ts") == sorted(train, key=repr)
    assert rows(split.valid, "user_id", "item_id", "rating", "ts") == sorted(valid, key=repr)
    assert {r[0] for r in split.users.collect()} == users and "hot" in users
    assert {r[0] for r in split.items.collect()} == {r[1] for r in train} | {r[1] for r in valid}
    stats = P.split_stats(split).first()
    assert (stats["n_users"], stats["n_train"], stats["n_valid"]) == (len(users), len(train), len(valid))


def test_steps_agree_with_the_whole(frames):
    train, valid = P.filter_common_ids(P.train_window(frames[0], 20), P.valid_window(frames[1], 10))
    users = P.users_with_min_rows(train, valid, 5, 3)
    assert {r[0] for r in users.collect()} == expected()[2]


def test_window_bound_is_included(spark):
    rows = [("u", "i", 5.0, START), ("u", "i", 5.0, START + dt.timedelta(days=20)), ("u", "i", 5.0, START - dt.timedelta(seconds=1))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert P.train_window(df, 20).count() == 2
    low = spark.createDataFrame([("u", "i", 1.0, START), ("u", "i", 5.0, START + dt.timedelta(days=11))], SCHEMA)
    assert P.valid_window(low, 10).count() == 0  # the low-rated first row still sets the window


def test_clean_interactions(spark, rows):
    raw = spark.createDataFrame(
        [
            ("u", "i", "4", "2024-02-03T\n10:00:00"),
            (None, "i", "4", "2024-02-03T10:00:00"),
            ("u", "i", "x", "2024-02-03T10:00:00"),
            ("u", "i", "4", "never"),
        ],
        "user_id string, item_id string, rating string, date_last_modified string",
    )
    got = P.clean_interactions(raw, sort=True)
    assert rows(got, "user_id", "item_id", "rating", "month", "quarter") == [("u", "i", 4.0, 2, 1)]


def test_recent_history(spark, frames):
    made = H.recent_history(frames[0], n=4, k_min=21)
    counts = {u: sum(r[0] == u for r in TRAIN) for u in {r[0] for r in TRAIN}}
    keep = {u for u, n in counts.items() if n >= 21}
    got = made.rows.collect()
    assert {r["user_id"] for r in got} == keep and keep
    assert {r["user_id"]: r["n_rows"] for r in made.rejects.collect()} == {u: n for u, n in counts.items() if n < 21}
    for u in keep:
        newest = sorted((r for r in TRAIN if r[0] == u), key=lambda r: r[3], reverse=True)[:4]
        mine = sorted((r for r in got if r["user_id"] == u), key=lambda r: r["rank"])
        assert [(r["item_id"], r["rating"], r["date"]) for r in mine] == [(r[1], r[2], f"{r[3]:%Y-%m-%d}") for r in newest]


def test_equal_times_are_ordered_by_item(spark):
    df = spark.createDataFrame([("u", i, 1.0, START) for i in ("c", "a", "b")], SCHEMA)
    got = H.recent_history(df, 2, 1).rows.orderBy("rank").collect()
    assert [r["item_id"] for r in got] == ["a", "b"]
    nested = H.nested_history(H.recent_history(df, 2, 1).rows).first()
    assert nested["items_to_exclude"] == ["a", "b"] and nested["n_history"] == 2


def test_attach_comments_refuses_repeats(spark, rows):
    inter = spark.createDataFrame([("u", "i", 1.0, START), ("u", "j", 1.0, START)], SCHEMA)
    reviews = spark.createDataFrame([("u", "i", START, "fine")], "user_id string, item_id string, ts timestamp, text string")
    assert rows(H.attach_comments(inter, reviews), "item_id", "user_comment") == [("i", "fine"), ("j", None)]
    with pytest.raises(DuplicateKeyError, match="left: user_id=u, item_id=i"):
        H.attach_comments(inter.union(inter), reviews)
    with pytest.raises(DuplicateKeyError, match="right"):
        H.attach_comments(inter, reviews.union(reviews))


def test_recent_history_joins_comments_after_the_limit(spark):
    day = dt.timedelta(days=1)
    inter = spark.createDataFrame([("u", "i", 1.0, START), ("u", "j", 2.0, START + day), ("u", "k", 3.0, START - day)], SCHEMA)
    reviews = spark.createDataFrame(
        [("u", "i", START, "fine"), ("u", "k", START - day, "old"), ("u", "k", START - day, "old again")],
        "user_id string, item_id string, ts timestamp, text string",
    )
    got = H.recent_history(inter, 2, 1, reviews=reviews).rows.orderBy("rank").collect()
    assert [(r["item_id"], r["user_comment"]) for r in got] == [("j", None), ("i", "fine")]
    with pytest.raises(DuplicateKeyError, match="right: user_id=u, item_id=k"):
        H.recent_history(inter, 3, 1, reviews=reviews)


def test_reviews_before_cutoff(spark, rows):
    day = dt.timedelta(days=1)
    inter = spark.createDataFrame([("u", "i", 1.0, START + day), ("u", "i", 1.0, START)], SCHEMA)
    reviews = spark.createDataFrame(
        [("u", "i", START, "old"), ("u", "i", START + day, "same"), ("v", "i", START, "other")],
        "user_id string, item_id string, ts timestamp, text string",
    )
    items = spark.createDataFrame([("i", "Soup")], "item_id string, title string")
    assert rows(H.reviews_before_cutoff(reviews, inter, items), "text", "title") == [("old", "Soup")]


def test_listing_is_chronological(spark):
    day = dt.timedelta(days=1)
    inter = spark.createDataFrame([("u", "j", 2.0, START + day), ("u", "i", 1.0, START)], SCHEMA)
    reviews = inter.select("user_id", "item_id", "ts", F.lit("c").alias("text"))
    items = spark.createDataFrame([("i", "Soup"), ("j", "Cake")], "item_id string, title string")
    assert [r["title"] for r in H.history_listing(inter, reviews, items).collect()] == ["Soup", "Cake"]
