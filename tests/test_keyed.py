"""Keyed updates that leave other buckets' files alone."""

from __future__ import annotations

import os

import pytest

from gustara.operators import relational as R
from gustara.sources import keyed as K

SCHEMA = "k int, v string"


def _files(path):
    out = {}
    for folder in os.listdir(path):
        if folder.startswith("__bucket"):
            out[int(folder.split("=")[1])] = {f for f in os.listdir(os.path.join(path, folder)) if f.endswith(".parquet")}
    return out


def test_update_touches_only_buckets_with_a_key(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    data = [(i, f"v{i}") for i in range(200)] + [(None, "no key"), (None, None), (5, "twice")]
    K.write_keyed(spark.createDataFrame(data, SCHEMA), path, "k", buckets=16)
    before = _files(path)
    updates = spark.createDataFrame([(5, "new"), (77, None), (100_000, "unmatched"), (None, "never")], SCHEMA)
    touched = K.update_keyed(spark, path, updates, "k", "v")
    after = _files(path)
    assert 1 <= len(touched) <= 2 and set(before) == set(after)
    assert all((before[b] == after[b]) == (b not in touched) for b in before)
    want = [(k, {5: "new", 77: None}.get(k, v)) for k, v in data]
    assert rows(K.read_keyed(spark, path)) == sorted(want, key=repr)


def test_new_column_and_unmatched_update(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    K.write_keyed(spark.createDataFrame([(i, str(i)) for i in range(20)], SCHEMA), path, "k", buckets=8)
    before = _files(path)
    assert K.update_keyed(spark, path, spark.createDataFrame([(99, 1.0)], "k int, w double"), "k", "w") == []
    assert {b: f for b, f in _files(path).items() if b >= 0} == {b: f for b, f in before.items() if b >= 0}
    assert K.read_keyed(spark, path).where("w is null").count() == 20
    K.update_keyed(spark, path, spark.createDataFrame([(3, 0.5), (4, None)], "k int, w double"), "k", "w")
    assert rows(K.read_keyed(spark, path), "k", "v", "w") == sorted([(i, str(i), 0.5 if i == 3 else None) for i in range(20)], key=repr)
    assert K.read_keyed(spark, path, ["w"]).where("w is not null").count() == 1


def test_repeated_update_keys_and_foreign_tables_are_errors(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], SCHEMA)
    K.write_keyed(df, path, "k", buckets=2)
    with pytest.raises(R.DuplicateKeyError):
        K.update_keyed(spark, path, df.union(df), "k", "v")
    plain = str(tmp_path / "plain")
    df.write.parquet(plain)
    with pytest.raises(ValueError, match="write_keyed"):
        K.read_keyed(spark, plain)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.createDataFrame([], SCHEMA)
    K.write_keyed(empty, path, "k")
    assert K.update_keyed(spark, path, spark.createDataFrame([(1, "a")], SCHEMA), "k", "v") == []
    assert K.update_keyed(spark, path, empty.withColumnRenamed("v", "w"), "k", "w") == []
    got = K.read_keyed(spark, path)
    assert sorted(got.columns) == ["k", "v", "w"] and got.count() == 0
