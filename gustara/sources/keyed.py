"""Tables in hash buckets of a key, so that a keyed update rewrites only buckets that hold an updated key.

A bucket is a partition folder. Its column's name carries the number of buckets, so readers and
writers of a table cannot disagree on it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustara.sources.tables import update_column

BUCKET = re.compile(r"^__bucket_of_(\d+)$")


def _bucket(df: DataFrame, key: str, n: int) -> Column:
    """The key's bucket; a NULL key has nothing to be found by, so its rows are spread by their content."""
    whole = F.xxhash64(*[F.col(c) for c, t in df.dtypes if "map<" not in t])
    hashed = F.when(F.col(key).isNull(), whole).otherwise(F.xxhash64(F.col(key).cast("string")))
    return F.pmod(hashed, F.lit(n)).cast("int")


def write_keyed(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Write a new table in ``buckets`` folders by a hash of ``key`` as text; an existing table is an error.

    Folders are balanced before the write: a bucket with a hot key is written by several tasks, small
    ones share a task.
    """
    name = f"__bucket_of_{buckets}"
    placed = df.withColumn(name, _bucket(df, key, buckets))
    placed.hint("rebalance", name).write.mode("errorifexists").partitionBy(name).parquet(path)
    _declare(df, path, name)


def read_keyed(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The table's rows; columns that an update has added are NULL in buckets it did not touch."""
    df = _stored(spark, path)
    return df.select(*columns) if columns else df.drop(_name(df)[0])


def update_keyed(spark: SparkSession, path: str, updates: DataFrame, key: str, column: str) -> list[int]:
    """Set ``column`` from ``updates`` where the key matches, as ``update_column`` does; returns the rewritten buckets.

    Buckets without a matching key keep their files. The new files are complete before the old ones of
    these buckets go; a job that dies before leaves the table as it was. One update of a table at a
    time. The column is created if missing, also where no key matches.
    """
    stored = _stored(spark, path)
    name, n = _name(stored)
    if column not in stored.columns:
        _declare(updates.select(column), path, name)
    asked = updates.select(F.col(key)).where(F.col(key).isNotNull())
    # At most one row per bucket each: first those an update could be in, then those it is in.
    possible = _numbers(asked.select(_bucket(asked, key, n).alias(name)), name)
    holds = stored.where(F.col(name).isin(possible)).select(key, name).join(asked, key, "left_semi")
    touched = _numbers(holds, name)
    if touched:
        updated = update_column(stored.where(F.col(name).isin(touched)), updates, key, column)
        writer = updated.hint("rebalance", name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(name).parquet(path)
        spark.catalog.refreshByPath(path)
    return touched


def _declare(df: DataFrame, path: str, name: str) -> None:
    """A file without rows in a folder of its own: tables without rows and columns without values have a type."""
    df.limit(0).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{name}=-1")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def _name(stored: DataFrame) -> tuple[str, int]:
    found = [(c, int(m.group(1))) for c in stored.columns if (m := BUCKET.match(c))]
    if len(found) != 1:
        raise ValueError("the table was not written by write_keyed")
    return found[0]


def _numbers(df: DataFrame, name: str) -> list[int]:
    return sorted(r[0] for r in df.select(name).distinct().collect())
