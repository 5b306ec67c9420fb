"""Implicit-feedback factorisation by its own weighted normal equations.

A value v of (user, item) is a confidence c = alpha * v. A row with item factors y solves

    (Y'Y + reg * I + sum (|c| - 1) y y') x = sum of c y over positive c,

so confidences weigh as given, negative ones say that the item is not wanted, and the penalty does
not grow with the number of entries. ``Y'Y`` is summed per task and then over tasks. Entries meet
the other side's factors in one join, are dealt by row and summed and solved where they arrive. A row
with very many entries is dealt in parts, whose sums are added up before it is solved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustara.operators.skew import attach
from gustara.session import materialize

PART_ROWS = 1 << 17
SMALL_SIDE = 10_000  # factors that are sent to every task


@dataclass(frozen=True)
class WeightedFactorisation:
    users: DataFrame  # user_id, embedding
    items: DataFrame  # item_id, embedding
    reg: float
    alpha: float

    def user_vectors(self) -> DataFrame:
        return self.users

    def item_vectors(self) -> DataFrame:
        return self.items


def weighted_als_fit(
    interactions: DataFrame,
    value: str = "rating",
    rank: int = 32,
    reg: float = 0.05,
    alpha: float = 2.0,
    iterations: int = 15,
    seed: int = 0,
    part_rows: int = PART_ROWS,
) -> WeightedFactorisation:
    """Fit on (user_id, item_id, value) rows; repeated pairs are summed, rows with a NULL are left out.

    Starts from user factors drawn by id and seed, so the fit does not depend on how rows are dealt.
    A sweep solves all items, then all users; each side is written before the other one reads it.
    """
    entries = _entries(interactions, value)
    if iterations < 1:
        raise ValueError("at least one sweep is needed")
    factors = {"user_id": materialize(start_factors(entries, rank, seed), "user-factors")}
    dealt = _dealt(_dealt(entries, "user_id", part_rows), "item_id", part_rows)
    entries = materialize(dealt, "entries")
    for _ in range(iterations):
        for row, column in (("item_id", "user_id"), ("user_id", "item_id")):
            factors[row] = solve_side(entries, factors[column], row, column, reg, alpha)
    return WeightedFactorisation(factors["user_id"], factors["item_id"], reg, alpha)


def start_factors(entries: DataFrame, rank: int, seed: int) -> DataFrame:
    """(user_id, embedding): small numbers drawn from a hash of id, place and seed."""
    place = F.sequence(F.lit(0), F.lit(rank - 1))
    drawn = F.transform(place, lambda j: F.pmod(F.xxhash64("user_id", j, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) * 0.01)
    return entries.select("user_id").distinct().select("user_id", drawn.alias("embedding"))


def fold_in(fitted: WeightedFactorisation, interactions: DataFrame, value: str = "rating", part_rows: int = PART_ROWS) -> DataFrame:
    """(user_id, embedding) of users the fit need not know, from their rows on items it knows.

    This is the last half of a sweep: for the rows of the fit it gives the fitted factors. Users
    without a known item have no row.
    """
    entries = _dealt(_entries(interactions, value), "user_id", part_rows)
    return solve_side(entries, fitted.items, "user_id", "item_id", fitted.reg, fitted.alpha)


def _entries(interactions: DataFrame, value: str) -> DataFrame:
    rows = interactions.select("user_id", "item_id", F.col(value).cast("double").alias("value")).dropna()
    return rows.where(~F.isnan("value")).groupBy("user_id", "item_id").agg(F.sum("value").alias("value"))


def _dealt(entries: DataFrame, row: str, part_rows: int) -> DataFrame:
    """Add in how many parts the entries of a row are summed."""
    parts = F.ceil(F.count("*") / part_rows).cast("int").alias(f"{row}_parts")
    return attach(entries, entries.groupBy(row).agg(parts), row)


def gram(factors: DataFrame) -> np.ndarray | None:
    """``Y'Y``: one matrix per task, added up by position; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for given in batches:
            if given.num_rows:
                y = _matrix(given.column("embedding"))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["cells"])

    cells = factors.select("embedding").mapInArrow(run, "cells array<double>").select(F.posexplode("cells").alias("place", "cell"))
    found = cells.groupBy("place").agg(F.sum("cell").alias("cell")).orderBy("place").collect()  # rank * rank numbers
    side = int(len(found) ** 0.5)
    return np.array([r["cell"] for r in found]).reshape(side, side) if found else None


def solve_side(entries: DataFrame, factors: DataFrame, row: str, column: str, reg: float, alpha: float) -> DataFrame:
    """(row, embedding): the exact solution for every row with an entry in a known column."""
    square = gram(factors)
    kind = entries.schema[row].dataType
    solved_schema = T.StructType([T.StructField(row, kind), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    if square is None:
        return entries.sparkSession.createDataFrame([], solved_schema)
    side = square.shape[0]
    base = square + reg * np.eye(side)
    part = F.pmod(F.xxhash64(column), F.col("parts")).cast("int").alias("part")
    met = entries.select(row, column, "value", F.col(f"{row}_parts").alias("parts")).select("*", part)
    if factors.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE:  # few factors: entries travel without them
        met = met.repartition(row, "part").join(F.broadcast(factors), column)
    else:
        met = met.join(factors, column).repartition(row, "part")
    dealt = met.sortWithinPartitions(row, "part").select(row, "part", "parts", "value", "embedding")
    schema = T.StructType([*solved_schema.fields, T.StructField("partial", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_type, held = None, None  # the row that may go on in the next batch: id, part, parts, sums
        for given in batches:
            if not given.num_rows:
                continue
            ids_type = given.schema.field(0).type
            ids = given.column(0).to_pylist()
            part, parts, value = (given.column(c).to_numpy() for c in ("part", "parts", "value"))
            y, c = _matrix(given.column("embedding")), alpha * value
            cuts = [0, *(n for n in range(1, len(ids)) if ids[n] != ids[n - 1] or part[n] != part[n - 1]), len(ids)]
            done = []
            for start, end in zip(cuts, cuts[1:]):
                mine, weight = y[start:end], c[start:end]
                left = mine.T @ (mine * (np.abs(weight) - 1.0)[:, None])
                right = mine.T @ np.maximum(weight, 0.0)
                if held is not None and held[:2] == (ids[start], part[start]):
                    left, right = held[3] + left, held[4] + right
                elif held is not None:
                    done.append(held)
                held = (ids[start], part[start], parts[start], left, right)
            if done:
                yield _finished(done, base, ids_type, schema)
        if held is not None:
            yield _finished([held], base, ids_type, schema)

    found = materialize(dealt.mapInArrow(run, schema), "solved")
    solved = found.where(F.col("partial").isNull()).select(row, "embedding")
    cells = found.where(F.col("partial").isNotNull()).select(row, F.posexplode("partial").alias("place", "cell"))
    total = cells.groupBy(row, "place").agg(F.sum("cell").alias("cell"))
    sums = total.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("place", "cell"))).alias("cells"))  # rank * (rank + 1) cells

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            if given.num_rows:
                cells = _matrix(given.column("cells"))
                x = _solve(base + cells[:, side:].reshape(-1, side, side), cells[:, :side])
                yield pa.RecordBatch.from_arrays([given.column(0), _lists(x)], names=solved_schema.names)

    split = sums.select(row, F.col("cells.cell").alias("cells")).mapInArrow(close, solved_schema)
    return materialize(solved.unionByName(split), "factors")


def _finished(rows: list[tuple], base: np.ndarray, ids_type: pa.DataType, schema: T.StructType) -> pa.RecordBatch:
    """Rows in one part with their solution, others with their sums: right side, then matrix."""
    whole = [r for r in rows if r[2] == 1]
    some = [r for r in rows if r[2] > 1]
    solved = _solve(base + np.stack([r[3] for r in whole]), np.stack([r[4] for r in whole])) if whole else []
    sums = [np.concatenate([r[4], r[3].ravel()]) for r in some]
    lists = pa.list_(pa.float64())
    columns = [
        pa.array([r[0] for r in whole + some], ids_type),
        pa.array([*solved, *[None] * len(some)], lists),
        pa.array([*[None] * len(whole), *sums], lists),
    ]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _solve(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of many positive definite systems, by Cholesky factors."""
    lower = np.linalg.cholesky(left)
    middle = np.linalg.solve(lower, right[:, :, None])
    return np.linalg.solve(lower.transpose(0, 2, 1), middle)[:, :, 0]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))
