"""Exact nearest neighbours with pruning: block pairs that cannot hold a neighbour are never formed.

The distances of all vectors to a few pivots are stored with them. Base vectors and queries are cut
into blocks: by nearest pivot, then by distance to it, so a block of either side keeps a narrow range
of distances to every pivot. By the triangle inequality two ranges that lie ``x`` apart for any pivot
keep all pairs of the two blocks at least ``x`` apart. Every query first meets the blocks closest to
its own block, enough of them to hold ``k`` rows; the distance of its k-th row so far is its radius.
Then only block pairs within the largest radius of the query block are formed, and inside a pair only
queries within their own radius are compared.

All three distances are read as lengths: cosine as the chord between unit vectors, the inner
product by one more coordinate that gives all base vectors the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from gustara.operators.blocks import CELL, BlockGrid
from gustara.operators.ordering import running_position, top_k
from gustara.operators.skew import attach
from gustara.operators.vector_search import DISTANCES, TIE_DIGITS, _block_search, _matrix, _vectors
from gustara.session import materialize

PIVOTS = 16
SAMPLED = 512  # rows among which the pivots are chosen
BLOCK_ROWS = 4096
# Distances to pivots carry rounding errors of about the root of the machine precision.
ROUNDING = 1e-7


@dataclass(frozen=True)
class VectorIndex:
    rows: DataFrame  # block, id, vec, away (distances to the pivots)
    blocks: DataFrame  # block, low, high (per pivot), n
    pivots: np.ndarray
    distance: str
    longest: float  # largest length of a base vector


def _lengths(vectors: np.ndarray, distance: str, longest: float, base: bool) -> np.ndarray:
    """The vectors in the space where the distance is a length."""
    if distance == "COSINE":
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    if distance == "EUCLIDEAN":
        return vectors
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0.0)) if base else np.zeros(len(vectors))
    return np.column_stack([vectors, rest])


def _spread_out(rows: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those chosen."""
    chosen = [0] if len(rows) else []
    gap = np.full(len(rows), np.inf)
    while chosen and len(chosen) < n:
        gap = np.minimum(gap, np.linalg.norm(rows - rows[chosen[-1]], axis=1))
        if gap.max() <= 0:
            break
        chosen.append(int(gap.argmax()))
    return rows[chosen]


def _placed(rows: DataFrame, pivots: np.ndarray, distance: str, longest: float, base: bool, block_rows: int) -> DataFrame:
    """Rows with ``block``, ``away`` and ``length``, written; a block holds at most ``block_rows`` rows."""
    fields = [("away", T.ArrayType(T.DoubleType())), ("cell", T.LongType()), ("near", T.DoubleType()), ("length", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            if not given.num_rows:
                continue
            vectors = _matrix(pa.chunked_array([given.column("vec")]))
            found = _lengths(vectors, distance, longest, base)
            if found.shape[1] != pivots.shape[1]:
                raise ValueError(f"vectors of {found.shape[1]} and {pivots.shape[1]} dimensions cannot be compared")
            away = np.stack([np.linalg.norm(found - p, axis=1) for p in pivots], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(len(away) + 1, dtype=np.int32) * len(pivots), pa.array(away.ravel()))
            cell = away.argmin(1)
            columns = [lists, pa.array(cell), pa.array(away[np.arange(len(away)), cell]), pa.array(np.linalg.norm(vectors, axis=1))]
            yield pa.RecordBatch.from_arrays([*given.columns, *columns], names=schema.names)

    ordered = running_position(rows.mapInArrow(run, schema), ["cell"], [("near", True), ("id", True)], "place")
    cut = F.floor((F.col("place") - 1) / block_rows).cast("long")
    return materialize(ordered.withColumn("block", F.shiftleft("cell", 40) + cut).drop("cell", "near", "place"), "blocks")


def _ranges(rows: DataFrame, n_pivots: int, *more: Column) -> DataFrame:
    """(block, low, high, n): the range of distances to every pivot, one row per block."""
    low = F.array(*[F.min(F.col("away")[i]) for i in range(n_pivots)]).alias("low")
    high = F.array(*[F.max(F.col("away")[i]) for i in range(n_pivots)]).alias("high")
    return rows.groupBy("block").agg(low, high, F.count("*").alias("n"), *more)


def build_index(
    base: DataFrame,
    distance: str = "COSINE",
    base_id: str = "item_id",
    vector: str = "embedding",
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> VectorIndex:
    """Cut the valid base vectors into blocks; ids are unique and compared as text.

    Pivots are chosen among ``SAMPLED`` rows (those of the smallest id hashes), so what reaches the
    driver does not grow. One index serves any number of searches.
    """
    if distance not in DISTANCES:
        raise ValueError(f"distance must be one of {DISTANCES}")
    rows = _vectors(base, base_id, vector)
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = rows.agg(F.sqrt(F.max(squares))).first()[0] or 0.0
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLED).select("vec").collect()
    if not sample:
        nothing = rows.withColumns({"block": F.lit(0).cast("long"), "away": F.array().cast("array<double>")})
        return VectorIndex(nothing, _ranges(nothing, 1), np.zeros((0, 0)), distance, longest)
    found = np.array([r["vec"] for r in sample], dtype=np.float64)
    chosen = _spread_out(_lengths(found, distance, longest, base=True), pivots)
    placed = _placed(rows, chosen, distance, longest, True, block_rows)
    blocks = materialize(_ranges(placed, len(chosen)), "ranges")
    return VectorIndex(placed.select("block", "id", "vec", "away"), blocks, chosen, distance, longest)


def _reach(index: VectorIndex, kth: Column) -> Column:
    """Radius as a length around a query of ``length`` whose k-th distance so far is ``kth``, ties included."""
    digits, longest = 10.0**-TIE_DIGITS, index.longest
    if index.distance == "COSINE":
        return F.sqrt(2.0 * (kth + 2 * digits + 1e-12)) + ROUNDING
    if index.distance == "EUCLIDEAN":
        return kth * (1 + 4 * digits) + ROUNDING * (F.col("length") + longest)
    slack = (2 * digits + 1e-12) * F.col("length") * longest
    square = F.col("length") ** 2 + longest**2 + 2.0 * (kth + slack)
    return F.sqrt(F.greatest(square, F.lit(0.0))) + ROUNDING * (F.col("length") + longest)


def _block_pairs(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query block, base block, least distance, n): from the ranges of both sides, in tasks of bounded size."""
    grid = BlockGrid.of(asked, blocks, F.size("low") * 16 + 32)
    schema = "qb bigint, block bigint, least double, n bigint"
    out = pa.schema([("qb", pa.int64()), ("block", pa.int64()), ("least", pa.float64()), ("n", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        (low, high), (base_low, base_high) = ((_matrix(t.column("low")), _matrix(t.column("high"))) for t in (left, right))
        least = np.zeros((len(low), len(base_low)))
        for p in range(low.shape[1]):
            least = np.maximum(least, base_low[:, p] - high[:, p, None])
            least = np.maximum(least, low[:, p, None] - base_high[:, p])
        block, n = (right.column(c).to_numpy() for c in ("block", "n"))
        columns = [np.repeat(left.column("block").to_numpy(), len(block)), np.tile(block, len(low)), least.ravel(), np.tile(n, len(low))]
        return pa.table([pa.array(c) for c in columns], schema=out)

    cells = grid.left(asked, "block").groupBy(*CELL).cogroup(grid.right(blocks, "block").groupBy(*CELL))
    return cells.applyInArrow(run, schema)


def _meet(pairs: DataFrame, asked: DataFrame, removed: DataFrame | None, index: VectorIndex, k: int) -> DataFrame:
    """The ``k`` nearest base rows per query and block pair; ``asked`` has a ``radius`` per query."""
    left = asked.join(pairs.select("qb", "block"), "qb").withColumn("excluded", F.lit(None).cast("string"))
    left = left.select("qb", "block", "id", "vec", "away", "radius", "excluded")
    if removed is not None:
        gone = removed.join(pairs.select("qb", "block"), ["qb", "block"], "left_semi")
        for name in ("vec", "away", "radius"):
            gone = gone.withColumn(name, F.lit(None).cast(left.schema[name].dataType))
        left = left.unionByName(gone)
    right = index.rows.join(pairs.select("qb", "block"), "block")
    search = _block_search(k, index.distance)

    def run(near: pa.Table, base: pa.Table) -> pa.Table:
        radius = near.column("radius").to_numpy()
        rows = np.flatnonzero(~np.isnan(radius))
        if rows.size and base.num_rows:
            away, there = _matrix(near.column("away").take(pa.array(rows))), _matrix(base.column("away"))
            least = np.maximum(away - there.max(0), there.min(0) - away).max(1)
            dropped = np.zeros(near.num_rows, bool)
            dropped[rows[least > radius[rows]]] = True
            near = near.filter(pa.array(~dropped))
        return search(near, base)

    cells = left.groupBy("qb", "block").cogroup(right.groupBy("qb", "block"))
    return cells.applyInArrow(run, "query string, base string, distance double, tie_key double")


def search_index(
    index: VectorIndex,
    queries: DataFrame,
    k: int = 20,
    query_id: str = "user_id",
    base_id: str = "item_id",
    vector: str = "embedding",
    exclude: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """(query_id, base_id, distance, rank) of the ``k`` nearest base rows per query: the rows of ``vector_search``.

    Invalid query vectors are left out; an empty side gives no rows. ``exclude`` holds (query_id,
    base_id) pairs, repeats allowed; a query with exclusions starts with as many rows more. ``counts``, if
    given, gets the number of block pairs there are (``pairs``) and of those formed (``formed``).
    """
    if not len(index.pivots):
        schema = f"`{query_id}` string, `{base_id}` string, distance double, rank int"
        return queries.sparkSession.createDataFrame([], schema)
    q = _placed(_vectors(queries, query_id, vector), index.pivots, index.distance, index.longest, False, block_rows)
    asked = q.withColumnRenamed("block", "qb")
    removed, most = None, F.lit(0).cast("long").alias("most")
    if exclude is not None:
        given = exclude.select(F.col(query_id).cast("string").alias("id"), F.col(base_id).cast("string").alias("excluded")).distinct()
        places = index.rows.select(F.col("id").alias("excluded"), "block")
        removed = materialize(attach(attach(given, asked.select("id", "qb"), "id"), places, "excluded"), "removed")
        per_query = removed.groupBy("qb", "id").agg(F.count("*").alias("gone"))
        q = attach(q, per_query.select("id", "gone"), "id", "left")
        most = F.coalesce(F.max("gone"), F.lit(0)).alias("most")
    ranges = materialize(_ranges(q, len(index.pivots), most), "query-ranges")
    pairs = _block_pairs(ranges, index.blocks)
    # Rows of a query block: the number of base blocks, never of vectors.
    before = W.partitionBy("qb").orderBy("least", "block").rowsBetween(W.unboundedPreceding, -1)
    pairs = attach(pairs, ranges.select(F.col("block").alias("qb"), "most"), "qb")
    first = F.coalesce(F.sum("n").over(before), F.lit(0)) < F.col("most") + k
    pairs = materialize(pairs.withColumn("first", first), "pairs")

    unlimited = asked.withColumn("radius", F.lit(float("inf")))
    near = materialize(_meet(pairs.where("first"), unlimited, removed, index, k), "near")
    best = top_k(near, ["query"], [F.col("tie_key").asc(), F.col("base").asc()], k)
    so_far = best.groupBy(F.col("query").alias("id")).agg(F.max("distance").alias("kth"), F.count("*").alias("found"))
    known = attach(asked, so_far, "id", "left")
    radius = F.when(F.col("found") >= k, _reach(index, F.col("kth"))).otherwise(F.lit(float("inf")))
    known = materialize(known.withColumn("radius", radius).drop("kth", "found"), "radii")
    widest = known.groupBy("qb").agg(F.max("radius").alias("widest"))
    rest = attach(pairs.where(~F.col("first")), widest, "qb").where(F.col("least") <= F.col("widest"))
    rest = materialize(rest, "rest")
    if counts is not None:
        counts["pairs"] = pairs.count()
        counts["formed"] = pairs.where("first").count() + rest.count()
    hits = near.unionByName(_meet(rest, known, removed, index, k))
    best = top_k(hits, ["query"], [F.col("tie_key").asc(), F.col("base").asc()], k)
    return best.select(F.col("query").alias(query_id), F.col("base").alias(base_id), "distance", "rank")
