"""Top-k and ranks that stay distributed when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gustara.operators.skew import attach
from gustara.session import materialize


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group, ranked from 1; ``order`` must end in a unique tie-break.

    Spark turns the filter on ``row_number`` into a per-partition limit before the shuffle, so
    a hot group sends at most ``k`` rows per input partition.
    """
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The smallest row of every group by ``order``, as a partial aggregate rather than a window."""
    rest = [c for c in df.columns if c not in group]
    picked = df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*group, "_row.*").select(*df.columns)


def running_position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[tuple[str, bool]],
    name: str,
    weight: str | None = None,
) -> DataFrame:
    """Exact 1-based position of every row in its group (or in the whole table without one).

    ``order`` lists (column, ascending) and must be unique within a group. With ``weight`` the
    position counts that many rows for each row, so it is 1 + the weight of all rows before.

    A plain window would sort a whole group in one task. Here rows are range-partitioned by
    group and order, so a hot group spreads over many slices; each slice numbers its own rows,
    and the totals of the slices before it are added. The slices are written once, so their
    numbers cannot change when a lost executor has to recompute.
    """
    keys = [F.col(g) for g in group] + [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    placed = df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id())
    placed = materialize(placed, "positions")
    step = F.col(weight) if weight else F.lit(1)
    in_group = [F.lit(0), *group]
    # One row per group and slice: bounded by the number of partitions.
    sizes = placed.groupBy(*group, "_slice").agg(F.sum(step).alias("_size"))
    before = W.partitionBy(*in_group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    ordering = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    local = W.partitionBy(*in_group[1:], "_slice").orderBy(*ordering)
    local = local.rowsBetween(W.unboundedPreceding, -1)
    numbered = placed.withColumn("_local", F.coalesce(F.sum(step).over(local), F.lit(0)))
    return (
        numbered.join(offsets, [*group, "_slice"])
        .withColumn(name, F.col("_offset") + F.col("_local") + 1)
        .drop("_offset", "_local", "_slice")
    )


def competition_rank(
    df: DataFrame, group: Sequence[str], score: str, name: str = "rank", ascending: bool = False
) -> DataFrame:
    """``rank()`` of every row by score, ties sharing the lowest rank, for groups of any size.

    Tied rows collapse to one counted row first, so a million equal scores are one row to rank.
    """
    counted = df.groupBy(*group, score).agg(F.count("*").alias("_n"))
    ranked = running_position(counted, group, [(score, ascending)], name, weight="_n").drop("_n")
    return attach(df, ranked, [*group, score])


def sort_rows(df: DataFrame, *keys: Column) -> DataFrame:
    """Global sort; meant for sinks and reports, since it range-partitions the whole table."""
    return df.orderBy(*keys)


def head(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """Deterministic ``head``: order, then limit (planned as a top-n, not a full sort)."""
    return df.orderBy(*keys).limit(n)
