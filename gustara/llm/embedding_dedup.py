"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors at cosine c are at squared distance 2 - 2c. After a rotation the coordinates are split
into blocks; by the pigeonhole, two vectors within the distance are, in some block, within that
block's share of it, in proportion to its size. Each block is a range join in a low-dimensional
space: its first coordinates are cut into cells twice as wide as the block's radius, a vector stands
in every cell that its radius reaches and asks in its own. Inside a cell, k-d leaves compare all
coordinates of the block; the distance summed over the blocks then thins out the candidates, and the
cosine in double precision decides. A pair counts in the first block that
brings it together, so no pair is counted twice and no pairs need to be written down.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustara.llm.common import quoted
from gustara.llm.components import components
from gustara.operators.skew import attach
from gustara.session import materialize

MINIMUM = 0.95
# Blocks have eight coordinates, or more in vectors so long that there would be over 16 blocks:
# each block sends every vector once more.
BLOCK_SIZE, MOST_BLOCKS, CELL_COORDINATES = 8, 16, 2
# Bytes of one side of a tile, its vectors in double precision.
TILE_BYTES = 32 << 20
LEAF_ROWS = 128
SLACK, SINGLE_SLACK = 1e-7, 1e-5


@functools.lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    """A fixed random rotation, so that no block of the given coordinates stands out."""
    draw = np.random.default_rng(size).normal(size=(size, size))
    return np.linalg.qr(draw)[0]


def block_edges(size: int) -> list[tuple[int, int]]:
    step = max(BLOCK_SIZE, -(-size // MOST_BLOCKS))
    return [(at, min(size, at + step)) for at in range(0, size, step)]


def shares(size: int, minimum: float) -> np.ndarray:
    """Squared distance allowed in each block, in proportion to its coordinates."""
    sizes = np.array([b - a for a, b in block_edges(size)])
    return (2 - 2 * minimum) * sizes / size + SLACK


def turned(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; the same numbers whatever rows stand beside one."""
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return np.einsum("ij,jk->ik", unit, rotation(vectors.shape[1]))


def cells_of(vectors: np.ndarray, minimum: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: its number, the rows, the cells they stand in, and whether that is the cell they ask in."""
    size = vectors.shape[1]
    place, out = turned(vectors), []
    for block, ((begin, end), share) in enumerate(zip(block_edges(size), shares(size, minimum), strict=True)):
        radius = np.sqrt(share)
        axes = place[:, begin : min(end, begin + CELL_COORDINATES)] / (2 * radius)
        home = np.floor(axes).astype(np.int64)
        # The reach is as long as half a cell to both sides: one neighbour in each direction at most.
        low, high = np.floor(axes - 0.5 - SLACK).astype(np.int64), np.floor(axes + 0.5 + SLACK).astype(np.int64)
        for corner in np.ndindex(*(3,) * axes.shape[1]):
            cell = low + np.array(corner)
            held = np.flatnonzero((cell <= high).all(1))
            key = np.zeros(held.size, np.int64)
            for axis in range(axes.shape[1]):
                key = key * 65_537 + cell[held, axis] + 16_384
            out.append((block, held, key, (cell[held] == home[held]).all(1)))
    return out


def spread_cells(vectors: DataFrame, minimum: float) -> DataFrame:
    """(size, block, cell, asks, id, weight, vector) for every cell a vector stands in."""
    from pyspark.sql import types as T

    wide = "size int, block int, cell bigint, asks boolean, id bigint, weight bigint, vector binary"
    schema = T._parse_datatype_string(wide)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            flat, begins = lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            for size in np.unique(lengths):
                rows = np.flatnonzero(lengths == size)
                data = flat[begins[rows][:, None] + np.arange(size)]
                raw = np.array([r.tobytes() for r in data], object)
                for block, held, key, asks in cells_of(data.astype(np.float64), minimum):
                    if held.size:
                        columns = [
                            pa.array(np.full(held.size, size, np.int32)), pa.array(np.full(held.size, block, np.int32)),
                            pa.array(key), pa.array(asks), pa.array(ids[rows][held]), pa.array(weights[rows][held]),
                            pa.array(raw[held], pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return vectors.select("id", "weight", "vector").mapInArrow(run, schema)


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of linked rows: ``root`` maps rows to their group's smallest row."""
    while a.size:
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def tile_links(
    block: int, asks: np.ndarray, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, minimum: float, split: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per asking row that has links in this cell: its id, the weight of its links, its group's smallest id."""
    order = np.argsort(ids)
    asks, ids, weights, vectors = asks[order], ids[order], weights[order], vectors[order].astype(np.float64)
    offered = np.arange(ids.size) if split is None else np.flatnonzero(split[order])
    asking = np.flatnonzero(asks)
    place, edges, share = turned(vectors), block_edges(vectors.shape[1]), shares(vectors.shape[1], minimum)
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    begin, end = edges[block]
    root, counts = np.arange(ids.size), np.zeros(ids.size, np.int64)
    for x, y in range_join(place[:, begin:end], asking, offered, share[block]):
        for cut in range(0, x.size, 1 << 16):
            a, b = x[cut : cut + (1 << 16)], y[cut : cut + (1 << 16)]
            other = ids[a] != ids[b]
            a, b = within_budget(place, edges, share, block, a[other], b[other])
            linked = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norm[a] * norm[b]) >= minimum
            a, b = a[linked], b[linked]
            np.add.at(counts, a, weights[b])
            join_roots(root, a, b)
    told = np.flatnonzero((counts > 0) | (root != np.arange(ids.size)))
    return ids[told], counts[told], ids[root[told]]


def leaves(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows in groups of at most ``LEAF_ROWS``, cut at the median of their widest coordinate."""
    out, left = [], [rows]
    while left:
        rows = left.pop()
        if rows.size <= LEAF_ROWS:
            out.append(rows)
            continue
        here = points[rows]
        axis = int(np.argmax(here.max(0) - here.min(0)))
        order, half = np.argpartition(here[:, axis], rows.size // 2), rows.size // 2
        left += [rows[order[:half]], rows[order[half:]]]
    return out


def range_join(points: np.ndarray, asking: np.ndarray, offered: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of an asking and an offered row within about ``share`` by squared distance; none of those within it is left out.

    Both sides are cut into k-d leaves; leaves whose boxes, in all coordinates, are further apart than
    the share are skipped. The distances of the others are single-precision products with a slack.
    """
    if not asking.size or not offered.size:
        return
    left, right = leaves(points, asking), leaves(points, offered)
    sizes, rows = np.array([r.size for r in right]), np.concatenate(right)
    lowest, highest = np.array([points[r].min(0) for r in right]), np.array([points[r].max(0) for r in right])
    square = np.einsum("ij,ij->i", points, points)
    one = np.ones_like(square)
    asks = np.column_stack([-2 * points, one, square]).astype(np.float32)
    offers = np.column_stack([points, square, one]).astype(np.float32)[rows]
    for leaf in left:
        low, high = points[leaf].min(0), points[leaf].max(0)
        gap = np.maximum(np.maximum(lowest - high, low - highest), 0)
        close = np.flatnonzero(np.repeat(np.einsum("ij,ij->i", gap, gap) <= share + SLACK, sizes))
        for at in range(0, close.size, 4096):
            some = close[at : at + 4096]
            near = np.flatnonzero(asks[leaf] @ offers[some].T <= np.float32(share + SINGLE_SLACK))
            if near.size:
                yield leaf[near // some.size], rows[some[near % some.size]]


def within_budget(
    place: np.ndarray, edges: list, share: np.ndarray, block: int, a: np.ndarray, b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose first block within its share is ``block`` and whose distance is within the whole budget.

    The squared distance grows block by block, and a pair goes as soon as it is too far or an earlier
    block has brought it together.
    """
    far, total = share.sum(), 0.0
    for other in [block, *(i for i in range(len(edges)) if i != block)]:
        begin, end = edges[other]
        gap = place[a, begin:end] - place[b, begin:end]
        square = np.einsum("ij,ij->i", gap, gap)
        total = total + square
        stay = total <= far
        if other <= block:
            stay &= (square <= share[block]) if other == block else (square > share[other])
        a, b, total = a[stay], b[stay], total[stay]
    return a, b


def link_vectors(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", minimum: float = MINIMUM, tile_rows: int | None = None
) -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Two vectors of the same length link if their cosine, in double precision, is at least ``minimum``
    (which must be below 1). ``n_links`` counts other rows linked directly, ``component_id`` is the
    smallest id reachable over links, ``kept`` tells the row of that id. Vectors that are NULL, empty
    or zero, or hold NULL or non-finite components, link with nothing. Ids are whole numbers; rows
    that share one are one row, and of their different vectors the one with the smallest hash counts.
    Rows without an id are one row as well: no links, and NULL as ``component_id`` and ``kept``.

    Equal vectors are one row with a weight. Cells with more than ``tile_rows`` rows (default: those
    of ``TILE_BYTES``) are cut into tiles by a hash of the id, every tile of asking rows with every
    tile of offered ones.
    """
    rows = table.select(F.col(quoted(vec_id)).cast("bigint").alias("id"), F.col(quoted(embedding)).alias("vector"))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    limit = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    usable = F.coalesce(finite & (F.size("vector") > 0), F.lit(False))
    usable = usable & F.coalesce(F.when(usable, (squares > 0) & (squares < limit)), F.lit(False))
    good = rows.where(usable & F.col("id").isNotNull()).select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    hashes = good.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    equal = materialize(hashes.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("weight")), "equal")
    member = materialize(attach(hashes, equal, ["h1", "h2"]).select("id", "node", "weight"), "members")
    nodes = good.join(equal.withColumnRenamed("node", "id"), ["id", "h1", "h2"]).dropDuplicates(["id"])
    cells = materialize(spread_cells(nodes.select("id", "weight", "vector"), minimum), "cells")
    width = next(f.dataType.elementType.simpleString() for f in table.schema.fields if f.name == embedding)
    kind = np.float32 if width == "float" else np.float64

    # Tiles: cells beyond the limit get as many parts on each side as their rows need.
    keys = ["size", "block", "cell"]
    counted = cells.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.col("asks").cast("int")).alias("asking"))
    most = F.lit(tile_rows) if tile_rows else F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (8 * F.col("size"))))
    parts = counted.where("asking > 0 and rows > 1").select(*keys, F.ceil(F.col("rows") / most).cast("int").alias("parts"))
    placed = attach(cells, parts, keys)
    mine = F.pmod(F.xxhash64("id"), "parts").cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    # A row goes to the tiles (its part, any) as an asking row and (any, its part) as an offered one.
    asked = F.when(F.col("asks"), F.transform(others, lambda j: F.struct(mine.alias("i"), j.alias("j")))).otherwise(F.array())
    offered = F.transform(others, lambda i: F.struct(i.alias("i"), mine.alias("j")))
    tiles = placed.withColumn("tile", F.explode(F.array_union(asked, offered)))
    tiles = tiles.select(
        *keys, "tile.i", "tile.j", "id", "weight", "vector",
        (F.col("asks") & (mine == F.col("tile.i"))).alias("asks"), (mine == F.col("tile.j")).alias("offered"),
    )

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        size, block = group["size"][0].as_py(), group["block"][0].as_py()
        asks, offered = group["asks"].to_numpy(), group["offered"].to_numpy()
        data = np.frombuffer(b"".join(group["vector"].to_pylist()), kind).reshape(-1, size)
        found = tile_links(block, asks, group["id"].to_numpy(), group["weight"].to_numpy(), data, minimum, offered)
        return pa.table(dict(zip(("id", "n", "root"), found, strict=True)))

    links = materialize(tiles.groupBy(*keys, "i", "j").applyInArrow(work, "id bigint, n bigint, root bigint"), "links")
    direct = links.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    node = attach(attach(member, direct.withColumnRenamed("id", "node"), "node", "left"), joined.withColumnRenamed("id", "node"), "node", "left")
    node = node.select(
        "id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    every = rows.select("id").distinct()
    told = attach(every, node, "id", "left")
    component = F.coalesce("component_id", "id")
    return told.select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), (component == F.col("id")).alias("kept"),
    )
