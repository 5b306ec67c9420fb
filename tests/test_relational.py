"""Joins, lists, set operations, sources and sinks."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from gustara.functions.scalars import map_get
from gustara.operators import relational as R
from gustara.schemas import RAW_INTERACTIONS
from gustara.operators.split import train_window
from gustara.session import materialize, work_dir
from gustara.sources import tables as T
from gustara.sources.files import binary_manifest, copy_files


def test_natural_join(spark, rows):
    a = spark.createDataFrame([(1, 2, "x"), (1, 3, "y")], "k int, l int, a string")
    b = spark.createDataFrame([(2, 1, "z")], "l int, k int, b string")
    assert rows(R.natural_join(a, b)) == [(1, 2, "x", "z")]
    with pytest.raises(ValueError, match="common"):
        R.natural_join(a, spark.range(1))


def test_suffixes_only_on_shared_names(spark):
    a = spark.createDataFrame([(1, 2, 3)], "k int, v int, only int")
    b = spark.createDataFrame([(1, 4)], "k int, v int")
    assert R.join_with_suffixes(a, b, ["k"], ("_a", "_b")).columns == ["k", "v_a", "only", "v_b"]


def test_hits_count_repeats_on_the_left_only(spark, rows):
    left = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b"), ("v", "c")], "k string, x string")
    right = spark.createDataFrame([("u", "a"), ("u", "a"), ("w", "c")], "k string, x string")
    assert rows(R.hits_in_list(left, right, "k", "x")) == [("u", 3, 2), ("v", 1, 0)]


def test_group_list_is_ordered_and_bounded(spark):
    df = spark.createDataFrame([("u", i, f"i{i}") for i in range(9, 0, -1)], "u string, rank int, item string").repartition(5)
    assert R.group_list(df, "u", ["item"], 3).first()["item"] == ["i1", "i2", "i3"]


def test_concat_first(spark, rows):
    a = spark.createDataFrame([("1", "first")], "id string, v string")
    b = spark.createDataFrame([("1", "second"), ("2", "second")], "id string, v string")
    assert rows(R.concat_first("id", a, b)) == [("1", "first"), ("2", "second")]


def test_subset_and_missing(spark):
    a, b = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("1",)], "id string")
    assert tuple(R.is_subset(a, b, "id").first()) == (False, 1)
    assert tuple(R.is_subset(b, a, "id").first()) == (True, 0)
    assert tuple(R.missing_lookups(a.union(a), b, "id").first()) == (2, 1)


def test_in_subquery_plans_as_semi_join(spark, rows):
    a, b = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("1",), ("1",)], "id string")
    found = R.where_in_subquery(a, b, "id")
    assert rows(found) == [("1",)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_group_count_keeps_rows_without_key(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(R.with_group_count(df, "k")) == sorted([("a", 2), ("a", 2), (None, None)], key=repr)


def test_map_get_keeps_a_present_null(spark, rows):
    df = spark.createDataFrame([({"k": "v"},), ({"k": None},), ({},)], "m map<string,string>")
    assert rows(df.select(map_get("m", "k", F.lit("d")))) == sorted([("v",), (None,), ("d",)], key=repr)


def test_skewed_join_is_split(spark):
    """One key with a third of the rows: the join reads it in several tasks, results stay whole."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        n = 60000
        key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 997))
        df = spark.range(0, n, 1, 16).select("id", key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        counted = R.with_group_count(df, "k")
        assert counted.where("n_rows = 20000 and k = 'hot'").count() == 20000
        counted.collect()
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_update_column(spark, rows):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "new")], "k int, v string")
    assert rows(T.update_column(target, updates, "k", "v")) == [(1, "a"), (2, "new")]
    emptied = spark.createDataFrame([(1, None), (3, "none asks for it")], "k int, v string")
    assert rows(T.update_column(target, emptied, "k", "v")) == sorted([(1, None), (2, "b")], key=repr)
    added = updates.withColumnRenamed("v", "w")
    assert rows(T.update_column(target, added, "k", "w")) == sorted([(1, "a", None), (2, "b", "new")], key=repr)
    with pytest.raises(R.DuplicateKeyError):
        T.update_column(target, updates.union(updates), "k", "v")


def test_csv_keeps_line_feeds_and_quotes(spark, rows, tmp_path):
    data = [("u", "i", "4", "2016-01-02\nT03:04\n"), ("u", 'say "hi", you', " 5 ", None)]
    df = spark.createDataFrame(data, RAW_INTERACTIONS)
    T.write_csv(df, str(tmp_path / "c"))
    assert rows(T.read_csv(spark, str(tmp_path / "c"), RAW_INTERACTIONS)) == sorted(data, key=repr)


def test_table_replaces_itself(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    T.replace_table(spark.createDataFrame([(1, "a")], "k int, v string"), path)
    T.enrich_table(spark, path, spark.createDataFrame([(1, "x")], "k int, w string"), "k")
    T.replace_table(T.read_table(spark, path).withColumn("n", F.lit(1)), path)
    assert rows(T.read_table(spark, path)) == [(1, "a", "x", 1)]
    assert os.listdir(tmp_path) == ["t"]


def test_published_table_changes_in_one_step(spark, rows, tmp_path):
    name, folder = "published_rows", str(tmp_path / "versions")
    first = T.publish_table(spark.createDataFrame([(1, "a")], "k int, v string"), name, folder)
    begun = T.read_table(spark, name)
    second = T.publish_table(begun.withColumn("n", F.lit(2)), name, folder)
    assert rows(T.read_table(spark, name)) == [(1, "a", 2)] and rows(begun) == [(1, "a")]
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(p) for p in (first, second))
    spark.sql(f"DROP VIEW {name}")


def test_materialize_reads_back_the_same(spark, rows):
    df = spark.createDataFrame([(1, [1.0], None)], "a int, b array<double>, c string")
    kept = materialize(df, "x")
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert kept.inputFiles() and tuple(kept.first()) == (1, [1.0], None)


def test_manifest_and_copy(spark, rows, tmp_path):
    source = tmp_path / "in" / "deep"
    source.mkdir(parents=True)
    for name in ("1.jpg", "2.jpg", "3.png"):
        (source / name).write_bytes(name.encode())
    ids = spark.createDataFrame([(1,), (3,), (9,)], "id int")
    manifest = binary_manifest(spark, str(tmp_path / "in"), ids, str(tmp_path / "out"))
    assert rows(manifest, "id", "length") == [("1", 5), ("3", 5)]
    assert "content" not in manifest._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    copy_files(manifest)
    assert (tmp_path / "out" / "deep" / "1.jpg").read_bytes() == b"1.jpg"
    assert not (tmp_path / "out" / "deep" / "2.jpg").exists()
    assert binary_manifest(spark, str(tmp_path / "in"), ids.where("id = 9"), "x").count() == 0


def test_a_cluster_without_shared_folder_is_refused():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(Session())


def test_the_configured_folder_is_used(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark) == folder
    assert materialize(spark.range(3), "here").inputFiles()[0].startswith(f"file://{folder}/here-")


def test_window_bound_reaches_the_reader(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("SELECT id, timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id AS INT)) AS ts FROM range(100)").write.parquet(path)
    recent = train_window(spark.read.parquet(path), 9).select("id")
    assert recent.count() == 10
    recent.collect()
    scans = [line for line in recent._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    filtered = [line for line in scans if "DataFilters: [isnotnull(ts" in line]
    assert filtered and "PushedFilters: [IsNotNull(ts)" in filtered[0]
    assert "Subquery" in filtered[0].split("DataFilters")[1].split("Format")[0]
