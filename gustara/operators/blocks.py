"""Meeting every row of one table with every row of another, block by block."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("lb", "rb")
MIN_LEFT_ROWS = 4096
CELL_ROW_BYTES = 64
CELLS_PER_TASK = 3


@dataclass(frozen=True)
class BlockGrid:
    """Hash blocks of two tables; each cell of the grid is one task with two bounded blocks.

    A side is copied once per block of the other side, so the shuffle grows with
    ``n_right * left + n_left * right`` rows, never with the number of row pairs.
    """

    n_left: int
    n_right: int

    @staticmethod
    def of(
        left: DataFrame,
        right: DataFrame,
        width: Column,
        block_bytes: int = 64 * 1024 * 1024,
        cell_rows: DataFrame | None = None,
    ) -> BlockGrid:
        """Cut both sides into blocks of about ``block_bytes``, by row count and mean row size.

        ``width`` is the size of a row in bytes; ``cell_rows`` are further rows that will go to
        single cells and count as part of the left side. The left side is cut finer, down to
        4096 rows a block, until every parallel task has some blocks to even out the load.
        """
        counts = _size(left, width, 0).union(_size(right, width, 1))
        if cell_rows is not None:
            counts = counts.union(_size(cell_rows, F.lit(CELL_ROW_BYTES), 2))
        found = {row["side"]: (row["n"], row["bytes"]) for row in counts.collect()}  # two or three rows
        (n_left, left_bytes), (n_right, right_bytes) = found[0], found[1]
        left_bytes += found.get(2, (0, 0))[1]
        rows = [max(1, int(block_bytes * n / b)) if b else 1 for n, b in ((n_left, left_bytes), (n_right, right_bytes))]
        tasks = left.sparkSession.sparkContext.defaultParallelism
        finer = min(CELLS_PER_TASK * tasks, math.ceil(n_left / MIN_LEFT_ROWS))
        return BlockGrid(max(1, math.ceil(n_left / rows[0]), finer), max(1, math.ceil(n_right / rows[1])))

    def left(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("lb", _block(key, self.n_left)).withColumn("rb", _every(self.n_right))

    def right(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("rb", _block(key, self.n_right)).withColumn("lb", _every(self.n_left))

    def cells(self, pairs: DataFrame, left_key: str, right_key: str) -> DataFrame:
        """Rows that concern one (left, right) pair go to its cell only."""
        return pairs.withColumn("lb", _block(left_key, self.n_left)).withColumn("rb", _block(right_key, self.n_right))


def _size(df: DataFrame, width: Column, side: int) -> DataFrame:
    total = F.coalesce(F.sum(width.cast("double")), F.lit(0.0))
    return df.agg(F.count("*").alias("n"), total.alias("bytes")).withColumn("side", F.lit(side))


def _block(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
