"""Reading and writing tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from gustara.operators.relational import require_unique
from gustara.session import materialize


CSV_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header in every file, whose quoted fields may span lines; a file is read by many tasks.

    Spark cuts files into byte ranges and a line belongs to the range in which it begins. A record
    begins at a line with an even number of quotes before it in the file: quotes are counted per
    range, the counts of a file's ranges are summed up (one row per range), and every line learns its
    parity inside its range. Records that begin and end in one line are parsed where they are; only the
    lines of longer ones are shuffled, to the line that their record begins with, however many ranges
    that is back. Fields follow RFC 4180: quotes inside are doubled, and a field with a quote is quoted.
    Empty lines are skipped; lines end with a line feed, after a carriage return or not.
    """
    lines = _csv_lines(spark, path)
    whole = lines.where(F.col("starts") & (F.col("odd") == 0))
    parts = lines.where(~F.col("starts") | (F.col("odd") == 1))
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("block", "seq", "value")))["value"], "\n").alias("value")
    spanning = parts.groupBy("file", "from_block", "from_seq").agg(joined)
    spanning = spanning.select("file", F.col("from_block").alias("block"), F.col("from_seq").alias("seq"), "value")
    records = whole.select("file", "block", "seq", "value").unionByName(spanning)
    heads = materialize(records.where("block = 0").groupBy("file").agg(F.min("seq").alias("head")), "heads")
    records = records.join(heads, "file").where((F.col("block") > 0) | (F.col("seq") > F.col("head")))
    text = F.regexp_replace("value", r"\r$", "")
    ddl = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    return records.where(text != "").select(F.from_csv(text, ddl, CSV_OPTIONS).alias("row")).select("row.*")


def _csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file, range (``block``) and place, the parity of its quotes (``odd``), whether a
    record ``starts`` with it, and the place of the line that its record starts with (``from_*``)."""
    odd = (F.length("value") - F.length(F.translate("value", '"', ""))) % 2
    read = spark.read.option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = materialize(read.select(*place, F.monotonically_increasing_id().alias("seq"), "value", odd.alias("odd")), "lines")
    in_file = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    counted = lines.groupBy("file", "block").agg(F.sum("odd").alias("n"))
    counted = counted.select("file", "block", (F.coalesce(F.sum("n").over(in_file), F.lit(0)) % 2).alias("open"))
    in_range = W.partitionBy("file", "block").orderBy("seq")
    before = F.coalesce(F.sum("odd").over(in_range.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ((before + F.col("open")) % 2 == 0).alias("starts")
    lines = lines.join(materialize(counted, "ranges"), ["file", "block"]).select("file", "block", "seq", "value", "odd", starts)
    begun = F.last(F.when(F.col("starts"), F.col("seq")), ignorenulls=True).over(in_range.rowsBetween(W.unboundedPreceding, 0))
    lines = materialize(lines.withColumn("begun", begun), "marked-lines")
    ends = lines.groupBy("file", "block").agg(F.max(F.when(F.col("starts"), F.col("seq"))).alias("last"))
    last = F.last(F.when(F.col("last").isNotNull(), F.struct("block", "last")), ignorenulls=True).over(in_file)
    carried = materialize(ends.select("file", "block", last.alias("carried")), "carried")
    rows = lines.join(carried, ["file", "block"])
    here = F.col("begun").isNotNull()
    from_block = F.when(here, F.col("block")).otherwise(F.col("carried.block"))
    from_seq = F.when(here, F.col("begun")).otherwise(F.col("carried.last"))
    return rows.select("file", "block", "seq", "value", "odd", "starts", from_block.alias("from_block"), from_seq.alias("from_seq"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that reads back unchanged: blanks and line feeds at the ends of a field are kept."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A catalogue table, or parquet files when ``name`` is a path; optionally some columns only."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return df.select(*columns) if columns else df


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a parquet table, also when ``df`` reads the table itself.

    The new version is complete in a sibling folder before the old one is moved aside, and the old
    one is moved back if the new one cannot take its place. Between the two moves readers of the path
    find nothing: readers that must not wait use a name that ``publish_table`` sets.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(staged)
    jvm = spark.sparkContext._jvm
    target, source, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staged, f"{staged}-old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    replaced = fs.exists(target)
    if replaced and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside; the new version is complete in {staged}")
    if not fs.rename(source, target):
        if replaced:
            fs.rename(aside, target)
        raise OSError(f"could not move {staged} to {path}; the new version is complete in the former")
    if replaced:
        fs.delete(aside, True)
    spark.catalog.refreshByPath(path)


def publish_table(df: DataFrame, name: str, folder: str) -> str:
    """Write ``df`` as a new version below ``folder`` and let the catalogue name ``name`` show it.

    ``df`` may read ``name`` itself and have other columns. The name is a view that changes in one
    step, so a reader sees the old or the new version, never none. Older versions stay for readers that
    have begun; delete their folders when none is left. Returns the new version's folder.
    """
    spark = df.sparkSession
    version = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(version)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{version}`")
    return version


def enrich_table(spark: SparkSession, path: str, extra: DataFrame, on: str) -> None:
    """Add columns to a table by a left join and replace it."""
    replace_table(read_table(spark, path).join(extra, on, "left"), path)


def update_column(target: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``target`` with ``column`` set from ``updates`` where the key matches.

    The column is created if missing; rows without a match keep their value or NULL, a matched NULL
    is set. The update keys must be unique.
    """
    require_unique([key], update=updates)
    incoming = updates.select(key, F.col(column).alias("_new"), F.lit(True).alias("_matched"))
    joined = target.join(incoming, key, "left")
    if column in target.columns:
        value = F.when(F.col("_matched"), F.col("_new")).otherwise(F.col(column))
        return joined.withColumn(column, value).drop("_new", "_matched")
    return joined.drop("_matched").withColumnRenamed("_new", column)


def create_namespace(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Create or replace a catalogue table."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
