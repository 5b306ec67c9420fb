"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every operator relies on: UTC timestamps, run-time re-planning with
# skew-join splitting (also where it costs one more exchange), Arrow for the Python stages.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "gustara",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """A session with the settings above; sizes are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return ship_package(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, as ``--py-files`` would."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="gustara-"), "gustara")
        archive = shutil.make_archive(target, "zip", os.path.dirname(root), os.path.basename(root))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that outlive an executor.

    The cluster names it in ``spark.checkpoint.dir``. A local session without one gets a
    temporary folder; on a cluster that would be lost with its machine, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="gustara-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, label: str = "step", partition_by: str | None = None, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Used after expensive or order-sensitive stages. Compared with ``checkpoint()`` the stage
    is computed once rather than twice, and readers of the table prune columns and know its
    size, which the join planner needs. With ``partition_by`` readers of one value skip the rest.
    Writers and readers hold a row group; ``group_rows`` bounds its rows where they are large.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    options = {} if group_rows is None else {"parquet.block.row.count.limit": group_rows}
    df.write.mode("errorifexists").options(**options).parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """The rows of a Python stage over ``partitions`` tasks, or as they come if it is None."""
    return df if partitions is None else df.repartition(partitions)
