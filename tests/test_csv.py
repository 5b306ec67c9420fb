"""Multi-line CSV read by many tasks, against Spark's own reader that takes a file as a whole."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from gustara.sources import tables

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("odd name", T.StringType()), T.StructField("x", T.DoubleType())])


def whole_files(spark, path):
    return spark.read.schema(SCHEMA).options(header=True, multiLine=True, quote='"', escape='"').csv(path)


def field(text):
    return '"' + text.replace('"', '""') + '"'


@pytest.fixture()
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0")]
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("size", [60, 1 << 20])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_same_rows_as_the_whole_file_reader(spark, rows, tmp_path, small_ranges, size, ending):
    draw = random.Random(size)
    texts = ['a "quoted" word', "two\nlines", "\n", '"', '""', "", "plain, with comma", "long " * 60 + "\n" * 5 + "end", " blank ", "é中\n\"x\""]
    for name in ("one", "two"):
        body = [ending.join(["id,odd name,x"])]
        for n in range(25):
            text = draw.choice(texts)
            shown = draw.choice(["plain", ""]) if draw.random() < 0.3 else field(text)
            body.append(f"{n},{shown},{n / 4}")
        body.insert(5, "")  # an empty line
        (tmp_path / f"{name}.csv").write_bytes((ending.join(body) + draw.choice(["", ending])).encode())
    small_ranges(size)
    got = tables.read_csv(spark, str(tmp_path), SCHEMA)
    assert got.columns == SCHEMA.names and got.count() == 50
    want = rows(whole_files(spark, str(tmp_path)))
    assert rows(got) == want
    if size == 60:
        ranges = tables._csv_lines(spark, str(tmp_path)).select("file", "block").distinct().count()
        assert ranges > 10


def test_quote_exactly_at_a_cut_and_files_without_rows(spark, rows, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('id,odd name,x\n1,"ab\n""cd\n",1\n2,e,2\n')
    (tmp_path / "b.csv").write_text("id,odd name,x\n")
    (tmp_path / "c.csv").write_text('"id","odd\nname",x\n3,"f",\n')
    for size in (17, 20, 21, 22):  # before and behind the first field's quotes
        small_ranges(size)
        assert rows(tables.read_csv(spark, str(tmp_path), SCHEMA)) == [(1, 'ab\n"cd\n', 1.0), (2, "e", 2.0), (3, "f", None)]
