"""Exact order statistics of many columns at once, by histograms that narrow around the wanted positions.

The first pass counts values by sign and binary exponent. Every later pass counts, for all columns
together, the values inside the buckets that hold a wanted position, in ``BUCKETS`` equal-width buckets
between the least and the greatest value seen there. A bucket with one value is an answer. Least and
greatest value never meet in a bucket, and an exponent spans 52 bits, so a handful of passes do. There
is no sort and no written table, and what the driver sees is bounded by columns, shares and ``BUCKETS``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
# Numbers beyond those of any finite exponent (-1074 to 1023), which are moved above 0.
MOVED, INFINITE, NOT_A_NUMBER = 1100, 4000, 5000


@dataclass
class Bracket:
    """Values from ``low`` to ``high`` of a column, after ``below`` smaller ones, and the positions wanted in it."""

    column: int
    low: float
    high: float
    below: int
    wanted: list[int]


def select_positions(df: DataFrame, columns: Sequence[str], wanted) -> list[dict[int, float]]:
    """Per column, the values at 0-based positions of its sorted values.

    ``wanted`` gives the positions for a number of values. NULLs are left out, NaN sorts last, and 0.0
    and -0.0 are one value. ``df`` is read once per pass: write an expensive one first.
    """
    values = [F.col(c).cast("double") for c in columns]
    known = reduce(Column.__or__, [v.isNotNull() for v in values])
    counts = _counted(df.where(known), [(v, v.isNotNull(), F.lit(0), _exponent(v)) for v in values])
    found: list[dict[int, float]] = [{} for _ in columns]
    opened = []
    for i in range(len(columns)):
        buckets = counts[i, 0]
        positions = sorted(set(wanted(sum(n for _, n, _, _ in buckets))))
        opened += _holding(i, buckets, 0, positions, found)
    while opened:
        by_column = defaultdict(list)
        for bracket in opened:
            by_column[bracket.column].append(bracket)
        cells = []
        for i, brackets in by_column.items():
            v, number, bucket = values[i], F.lit(None).cast("int"), F.lit(None).cast("int")
            for at, b in enumerate(brackets):
                inside = v.between(b.low, b.high)
                number = F.when(inside, F.lit(at)).otherwise(number)
                share = (v - F.lit(b.low)) / F.lit(b.high - b.low)
                bucket = F.when(inside, F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).otherwise(bucket)
            inside = reduce(Column.__or__, [v.between(b.low, b.high) for b in brackets])
            cells.append((v, inside, number, bucket))
        counts = _counted(df.where(reduce(Column.__or__, [c[1] for c in cells])), cells)
        opened = []
        for cell, (i, brackets) in enumerate(by_column.items()):
            for at, b in enumerate(brackets):
                opened += _holding(i, counts[cell, at], b.below, b.wanted, found)
    return found


def select_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Per column, the linear-interpolated quantiles of its values; None without a value."""
    totals = {}

    def wanted(total):
        totals[len(totals)] = total
        places = [(total - 1) * s for s in shares]
        return [f(p) for p in places for f in (math.floor, math.ceil)] if total else []

    out = {}
    for i, (name, found) in enumerate(zip(columns, select_positions(df, columns, wanted), strict=True)):
        row = []
        for share in shares:
            place = (totals[i] - 1) * share
            low, high = (found.get(f(place)) for f in (math.floor, math.ceil))
            row.append(low if low == high else low + (high - low) * (place - math.floor(place)))
        out[name] = row
    return out


def _exponent(v: Column) -> Column:
    """A whole number that grows with the value, one per sign and binary exponent."""
    size = F.floor(F.log2(F.abs(v))).cast("int") + MOVED
    special = F.when(F.isnan(v), NOT_A_NUMBER).when(v == math.inf, INFINITE).when(v == -math.inf, -INFINITE)
    return special.when(v == 0, 0).when(v > 0, size).otherwise(-size)


def _counted(df: DataFrame, cells: list[tuple[Column, Column, Column, Column]]) -> dict[tuple[int, int], list[tuple]]:
    """Sorted (bucket, rows, least, greatest) by number of the cell and of its bracket, from one aggregate.

    A cell is a value, whether the row counts, its bracket and its bucket.
    """
    structs = [
        F.when(inside, F.struct(F.lit(i).alias("cell"), number.alias("at"), bucket.alias("bucket"), v.alias("v")))
        for i, (v, inside, number, bucket) in enumerate(cells)
    ]
    rows = df.select(F.explode(F.array(*structs)).alias("r")).where("r is not null").select("r.*")
    # At most BUCKETS rows (about 4,200 in the first pass) per cell and bracket.
    grouped = rows.groupBy("cell", "at", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    out = defaultdict(list)
    for row in grouped.toArrow().to_pylist():
        out[row["cell"], row["at"]].append((row["bucket"], row["n"], row["low"], row["high"]))
    for buckets in out.values():
        buckets.sort(key=lambda b: b[0])
    return out


def _holding(column: int, buckets: list[tuple], below: int, positions: list[int], found: list[dict[int, float]]) -> list[Bracket]:
    """Brackets of the buckets that hold a position; those of one value go to ``found`` at once."""
    out = []
    for _, n, low, high in buckets:
        here = [p for p in positions if below <= p < below + n]
        if here and (low == high or math.isnan(low)):
            found[column].update(dict.fromkeys(here, low))
        elif here:
            out.append(Bracket(column, low, high, below, here))
        below += n
    return out
