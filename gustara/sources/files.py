"""Folders of binary files."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from gustara.functions.scalars import file_stem, relative_path


def binary_manifest(spark: SparkSession, folder: str, allowed: DataFrame, prefix: str) -> DataFrame:
    """(id, src, dst, length) of files below ``folder`` whose stem is an allowed id.

    File contents are not read: the binary column is pruned. No match gives an empty table.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select(
            file_stem("path").alias("id"),
            F.col("path").alias("src"),
            F.concat(F.lit(prefix.rstrip("/") + "/"), relative_path("path", folder)).alias("dst"),
            "length",
        )
    )
    return files.join(allowed.select(F.col(allowed.columns[0]).cast("string").alias("id")), "id", "left_semi")


def write_files(rows: DataFrame, folder: str, ending: str) -> None:
    """Write every (id, content) row as the file ``id`` with this ending below ``folder``, on the executors."""

    def write_partition(part: Iterator[Row]) -> None:
        target, path = fs.FileSystem.from_uri(_as_uri(folder))
        target.create_dir(path, recursive=True)
        for name, content in part:
            with target.open_output_stream(f"{path}/{name}.{ending}") as out:
                out.write(bytes(content))

    rows.foreachPartition(write_partition)


def copy_files(manifest: DataFrame) -> None:
    """Copy every manifest row, file by file, on the executors."""

    def copy_partition(rows: Iterator[Row]) -> None:
        for row in rows:
            source, source_path = fs.FileSystem.from_uri(_as_uri(row["src"]))
            target, target_path = fs.FileSystem.from_uri(_as_uri(row["dst"]))
            target.create_dir(target_path.rsplit("/", 1)[0], recursive=True)
            fs.copy_files(source_path, target_path, source_filesystem=source, destination_filesystem=target)

    manifest.select("src", "dst").foreachPartition(copy_partition)


def _as_uri(path: str) -> str:
    if path.startswith("file:"):
        return "file://" + path[len("file:"):].lstrip("/").join(["/", ""])
    return path if "://" in path else "file://" + path
