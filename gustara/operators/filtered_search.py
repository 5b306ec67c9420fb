"""Exact nearest neighbours where every query brings its own filter on the base rows' attributes.

The blocks are those of ``vector_search``. In a task, each attribute value has a bitmap of the base rows
that hold it; a filter is the intersection, over its attributes, of the union of its values' bitmaps, and
only rows whose bit is set are compared. Queries with one filter share that work, and k rows remain
per query where that many match, which filtering a finished list could not promise.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustara.operators.blocks import CELL, BlockGrid
from gustara.operators.ordering import top_k
from gustara.operators.vector_search import _CELLS, DISTANCES, Screen, _found, _id_order, _lengths, _matrix, _nearest, _stored, _vectors

NOTHING = (np.empty(0, dtype=int), np.empty(0, dtype=int))


def filtered_search(
    base: DataFrame,
    queries: DataFrame,
    attributes: Sequence[str],
    filters: str = "filters",
    k: int = 20,
    distance: str = "COSINE",
    base_id: str = "item_id",
    query_id: str = "user_id",
    vector: str = "embedding",
    block_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """(query_id, base_id, distance, rank) of the ``k`` nearest base rows per query that pass the query's filter.

    ``filters`` maps attribute names to lists of values, compared as text: a base row passes if, for every
    name, it holds one of the values. A NULL or empty map lets all rows pass, an empty list none; a
    NULL attribute equals no value. Queries without a passing row have no row. A name that is not in
    ``attributes`` is an error. Vectors, ids and ties are handled as in ``vector_search``.
    """
    if distance not in DISTANCES:
        raise ValueError(f"distance must be one of {DISTANCES}")
    held = F.array(*[F.col(a).cast("string") for a in attributes]).cast("array<string>").alias("held")
    b = _vectors(base, base_id, vector, held)
    asked = F.coalesce(F.to_json(F.col(filters)), F.lit("{}")).alias("filter")
    q = _vectors(queries, query_id, vector, asked)
    grid = BlockGrid.of(q, b, F.size("vec") * 8, block_bytes)
    search = _block_search(list(attributes), k, distance)
    found = (
        grid.left(q, "id")
        .groupBy(*CELL)
        .cogroup(grid.right(b, "id").groupBy(*CELL))
        .applyInArrow(search, "query string, base string, distance double, tie_key double")
    )
    best = top_k(found, ["query"], [F.col("tie_key").asc(), F.col("base").asc()], k)
    return best.select(F.col("query").alias(query_id), F.col("base").alias(base_id), "distance", "rank")


def bitmaps(held: Sequence[Sequence[str | None]], attributes: Sequence[str]) -> dict[str, dict[str, np.ndarray]]:
    """Packed bits of the rows that hold each value, by attribute and value."""
    out = {}
    for i, name in enumerate(attributes):
        rows = defaultdict(list)
        for row, values in enumerate(held):
            if values[i] is not None:
                rows[values[i]].append(row)
        out[name] = {value: _bits(places, len(held)) for value, places in rows.items()}
    return out


def passing(wanted: dict[str, list[str | None] | None], maps: dict[str, dict[str, np.ndarray]], n: int) -> np.ndarray:
    """Ascending numbers of the rows that pass a filter; a NULL list is an empty one."""
    unknown = set(wanted) - set(maps)
    if unknown:
        raise ValueError(f"filters name unknown attributes: {sorted(unknown)}")
    kept = _bits(range(n), n)
    for name, values in wanted.items():
        either = np.zeros_like(kept)
        for value in values or ():
            if value in maps[name]:
                either |= maps[name][value]
        kept &= either
    return np.flatnonzero(np.unpackbits(kept, count=n))


def _bits(places, n: int) -> np.ndarray:
    flags = np.zeros(n, dtype=bool)
    flags[list(places)] = True
    return np.packbits(flags)


def _block_search(attributes: list[str], k: int, distance: str):
    out = pa.schema([("query", pa.string()), ("base", pa.string()), ("distance", pa.float64()), ("tie_key", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return out.empty_table()
        by_id = _id_order(right)  # equal keys then resolve in id order
        ids, base = right.column("id").combine_chunks().take(pa.array(by_id)), _stored(right.column("vec"), by_id)
        maps = bitmaps(right.column("held").take(pa.array(by_id)).to_pylist(), attributes)
        asked, query = left.column("id").combine_chunks(), _matrix(left.column("vec"))
        if base.shape[1] != query.shape[1]:
            raise ValueError(f"vectors of {query.shape[1]} and {base.shape[1]} dimensions cannot be compared")
        if distance == "COSINE":
            query /= _lengths(query)[:, None]
        whole = Screen(base, distance)
        by_filter = defaultdict(list)
        for row, wanted in enumerate(left.column("filter").to_pylist()):
            by_filter[wanted].append(row)
        parts = []
        for wanted, rows in by_filter.items():
            columns = passing(json.loads(wanted), maps, len(ids))
            if not columns.size:
                continue
            some, step = whole.of(columns), max(1, _CELLS // columns.size)
            for at in range(0, len(rows), step):
                mine = np.array(rows[at : at + step])
                r, c, dist, key = _nearest(query[mine], some, k, distance, NOTHING)
                parts.append((mine[r], columns[c], dist, key))
        return _found(parts, asked, ids, out) if parts else out.empty_table()

    return run
