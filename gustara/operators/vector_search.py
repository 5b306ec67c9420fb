"""Exact nearest neighbours by blocks of vectors.

Every query has to meet every base vector, but no row pair leaves a task. Both sides are hashed
into blocks of bounded size, each pair of blocks meets in one task that multiplies two small
matrices, and only the best k per query and block pair are shuffled to the final merge. Task
memory depends on the block size, not on the tables. Items to exclude travel as (query, base)
rows to the one block pair they concern, so a long exclusion list is spread as well and k rows
always remain where enough base rows exist.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustara.functions.scalars import is_valid_vector
from gustara.operators.blocks import CELL, BlockGrid
from gustara.operators.ordering import top_k
from gustara.session import materialize

DISTANCES = ("COSINE", "DOT_PRODUCT", "EUCLIDEAN")
# Distances equal to this many digits are ties, ordered by base id: decimals for COSINE, whose
# distances are of the order of 1, significant digits for the others, whose vectors have any length.
TIE_DIGITS = 9
_CELLS = 4_000_000  # distances held at a time
_LOOKUP = 131_072  # excluded pairs looked up at a time
_ROWS = 4_096  # vectors, or pairs of them, taken in double precision at a time
_GROUP = 32  # columns per group of the short list


def valid_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.where(is_valid_vector(column))


def vector_search(
    base: DataFrame,
    queries: DataFrame,
    k: int = 20,
    distance: str = "COSINE",
    base_id: str = "item_id",
    query_id: str = "user_id",
    vector: str = "embedding",
    exclude: DataFrame | None = None,
    block_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """(query_id, base_id, distance, rank) of the ``k`` nearest base rows per query.

    Invalid vectors (``is_valid_vector``) on either side are left out. Ids are unique and compared as text.
    DOT_PRODUCT is the negated product, so smaller is closer for every distance. ``exclude``
    holds (query_id, base_id) pairs, repeats allowed. The inputs are counted before they are
    used; materialise them if they are costly.
    """
    if distance not in DISTANCES:
        raise ValueError(f"distance must be one of {DISTANCES}")
    best = _best(_vectors(base, base_id, vector), _vectors(queries, query_id, vector), k, distance, _pairs(exclude, query_id, base_id), block_bytes)
    return best.select(
        F.col("query").alias(query_id), F.col("base").alias(base_id), "distance", "rank"
    )


def search_repeated(
    base: DataFrame,
    queries: DataFrame,
    k: int = 20,
    distance: str = "COSINE",
    base_id: str = "item_id",
    query_id: str = "user_id",
    vector: str = "embedding",
    block_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """The rows of ``vector_search`` without exclusions, for tables in which many vectors are equal.

    Equal vectors are one class on either side, and only classes are compared. The ``k`` nearest base
    classes of a query class, by distance and first id, hold its ``k`` nearest rows, and of each
    only the ``k`` smallest ids can be among them.
    """
    if distance not in DISTANCES:
        raise ValueError(f"distance must be one of {DISTANCES}")
    b_classes, b_rows = _classes(_vectors(base, base_id, vector))
    q_classes, q_rows = _classes(_vectors(queries, query_id, vector))
    smallest = materialize(top_k(b_rows, ["class"], [F.col("id").asc()], k), "smallest-ids")
    first = smallest.where(F.col("rank") == 1).select("class", F.col("id").alias("first"))
    # The first id leads, so ties between classes resolve by it; the class number keeps repeated ids apart.
    named = b_classes.join(first, "class").select(F.concat_ws("\0", "first", F.col("class").cast("string")).alias("id"), "vec")
    named = materialize(named, "base-classes")
    near = _best(named, q_classes.select(F.col("class").cast("string").alias("id"), "vec"), k, distance, None, block_bytes)
    near = near.select(
        F.col("query").cast("bigint").alias("asked"), F.substring_index("base", "\0", -1).cast("bigint").alias("class"), "distance", "tie_key"
    )
    order = [F.col("tie_key").asc(), F.col("base").asc()]
    met = materialize(near, "near-classes").join(smallest.select("class", F.col("id").alias("base")), "class")
    lists = materialize(top_k(met, ["asked"], order, k).drop("rank", "class"), "class-lists")
    found = q_rows.join(lists, F.col("class") == F.col("asked")).select(F.col("id").alias("query"), "base", "distance", "tie_key")
    # A repeated query id ranks the rows of all its vectors together.
    best = top_k(found, ["query"], order, k)
    return best.select(F.col("query").alias(query_id), F.col("base").alias(base_id), "distance", "rank")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, vec) of the distinct vectors and (class, id) of all rows."""
    distinct = rows.select("vec").distinct().withColumn("class", F.monotonically_increasing_id())
    classes = materialize(distinct, "classes")
    return classes, materialize(rows.join(classes, "vec").select("class", "id"), "members")


def _pairs(exclude: DataFrame | None, query_id: str, base_id: str) -> DataFrame | None:
    if exclude is None:
        return None
    return exclude.select(F.col(query_id).cast("string").alias("id"), F.col(base_id).cast("string").alias("excluded"))


def _best(b: DataFrame, q: DataFrame, k: int, distance: str, exclude: DataFrame | None, block_bytes: int) -> DataFrame:
    """(query, base, distance, tie_key, rank) for rows of (id, vec)."""
    grid = BlockGrid.of(q, b, F.size("vec") * 8, block_bytes, exclude)
    query_rows = grid.left(q.withColumn("excluded", F.lit(None).cast("string")), "id")
    if exclude is not None:
        pairs = exclude.join(q.select("id"), "id", "left_semi").distinct()
        removed = grid.cells(pairs, "id", "excluded").withColumn("vec", F.lit(None).cast(q.schema["vec"].dataType))
        query_rows = query_rows.unionByName(removed)
    candidates = (
        query_rows.groupBy(*CELL)
        .cogroup(grid.right(b, "id").groupBy(*CELL))
        .applyInArrow(_block_search(k, distance), "query string, base string, distance double, tie_key double")
    )
    return top_k(candidates, ["query"], [F.col("tie_key").asc(), F.col("base").asc()], k)


def _vectors(df: DataFrame, id_column: str, vector: str, *more: Column) -> DataFrame:
    """Ids as text; vectors as stored, so single precision travels at half the size; and ``more`` columns."""
    kept = valid_vectors(df, vector).select(F.col(id_column).cast("string").alias("id"), F.col(vector).alias("vec"), *more)
    if isinstance(kept.schema["vec"].dataType.elementType, (T.FloatType, T.DoubleType)):
        return kept
    return kept.withColumn("vec", F.col("vec").cast("array<double>"))


def _block_search(k: int, distance: str):
    out = pa.schema(
        [("query", pa.string()), ("base", pa.string()), ("distance", pa.float64()), ("tie_key", pa.float64())]
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        is_vector = left.column("excluded").is_null()
        vectors = left.select(["id", "vec"]).filter(is_vector) if left.column("excluded").null_count < left.num_rows else left
        if vectors.num_rows == 0 or right.num_rows == 0:
            return out.empty_table()
        query_ids, by_id = vectors.column("id").combine_chunks(), _id_order(right)  # equal keys below then resolve in id order
        base_ids = right.column("id").combine_chunks().take(pa.array(by_id))
        skip_rows, skip_cols = _positions(left.select(["id", "excluded"]), query_ids, base_ids)
        query, base = _matrix(vectors.column("vec")), _stored(right.column("vec"), by_id)
        if base.shape[1] != query.shape[1]:
            raise ValueError(f"vectors of {query.shape[1]} and {base.shape[1]} dimensions cannot be compared")
        if distance == "COSINE":
            query /= _lengths(query)[:, None]
        screen = Screen(base, distance)
        parts = []
        step = max(1, _CELLS // len(base))
        for start in range(0, len(query), step):
            some = slice(*np.searchsorted(skip_rows, [start, start + step]))
            skip = (skip_rows[some] - start, skip_cols[some])
            rows, cols, dist, key = _nearest(query[start : start + step], screen, k, distance, skip)
            parts.append((rows + start, cols, dist, key))
        del query, base, screen  # before the result is built
        return _found(parts, query_ids, base_ids, out)

    return run


def _id_order(table: pa.Table) -> np.ndarray:
    """Rows of a block in the order of their ids."""
    return pc.sort_indices(table.column("id").combine_chunks()).to_numpy().astype(np.int64)


def _stored(column: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    """Vectors as rows in the precision they have in the column."""
    return _matrix(column, order, np.float32 if column.type.value_type == pa.float32() else np.float64)


def _matrix(column: pa.ChunkedArray, order: np.ndarray | None = None, kind: type = np.float64) -> np.ndarray:
    """Vectors as rows of doubles, filled chunk by chunk; row i is the column's row ``order[i]``."""
    chunks = [c for c in column.chunks if len(c)]
    lengths = {int(n) for c in chunks for n in np.unique(np.diff(c.offsets.to_numpy()))}
    if len(lengths) > 1:
        raise ValueError(f"vectors of different dimensions in one column: {sorted(lengths)}")
    out, at = np.empty((len(column), max(lengths, default=0)), dtype=kind), 0
    places = None if order is None else _places(order)
    for c in chunks:
        rows = slice(at, at + len(c))
        out[rows if places is None else places[rows]] = c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        at += len(c)
    return out


def _places(order: np.ndarray) -> np.ndarray:
    places = np.empty(len(order), dtype=np.int64)
    places[order] = np.arange(len(order))
    return places


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def _positions(left: pa.Table, query_ids: pa.Array, base_ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every excluded pair that is present in this block pair, by row; ``_LOOKUP`` pairs are looked up at a time."""
    found = [(np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32))]
    for at in range(0, left.num_rows, _LOOKUP):
        some = left.slice(at, _LOOKUP)
        removed = some.filter(some.column("excluded").is_valid())
        if removed.num_rows:
            rows, cols = (_last_place(removed.column(c), ids) for c, ids in (("id", query_ids), ("excluded", base_ids)))
            present = (rows >= 0) & (cols >= 0)
            found.append((rows[present], cols[present]))
    rows, cols = (np.concatenate(c) for c in zip(*found, strict=True))
    del found
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order]


def _last_place(wanted: pa.ChunkedArray, ids: pa.Array) -> np.ndarray:
    """Place of each wanted id among the ids, the last one of equal ids, or -1."""
    backwards = ids.take(pa.array(np.arange(len(ids))[::-1]))
    found = pc.fill_null(pc.index_in(wanted, value_set=backwards), len(ids)).to_numpy()
    return (len(ids) - 1 - found).astype(np.int32)


def _found(parts: list[tuple], query_ids: pa.Array, base_ids: pa.Array, out: pa.Schema) -> pa.Table:
    """Rows of the result from places of queries and base rows."""
    rows, cols, dist, key = (np.concatenate(c) for c in zip(*parts, strict=True))
    columns = [query_ids.take(pa.array(rows)), base_ids.take(pa.array(cols)), pa.array(dist), pa.array(key)]
    return pa.table(columns, schema=out)


class Screen:
    """Base vectors as stored with what the short list needs: lengths, and a copy in single precision where that cannot overflow.

    Doubles are made of the rows that are asked for; for COSINE these have unit length.
    """

    def __init__(self, stored: np.ndarray, distance: str):
        self.stored, self.distance, n = stored, distance, len(stored)
        pieces = [slice(at, at + _ROWS) for at in range(0, n, _ROWS)]
        self.sizes = np.empty(n) if distance == "COSINE" else None
        self.lengths, self.small = np.empty(n), np.empty(stored.shape, dtype=np.float32)
        with np.errstate(over="ignore"):  # the copy is dropped then
            for some in pieces:
                if self.sizes is not None:
                    self.sizes[some] = _lengths(stored[some].astype(np.float64))
                rows = self.rows(some)
                self.lengths[some], self.small[some] = _lengths(rows), rows
        self.largest = self.lengths.max()
        if not 1e-15 < self.largest < 1e15:
            self.small = None

    def rows(self, places: np.ndarray | slice) -> np.ndarray:
        found = self.stored[places].astype(np.float64, copy=False)
        return found if self.sizes is None else found / self.sizes[places, None]

    def of(self, columns: np.ndarray) -> Screen:
        return self if len(columns) == len(self.stored) else Screen(self.stored[columns], self.distance)


def _nearest(query, screen, k, distance, skip):
    """Row, column, distance and tie key of the k nearest base rows per query, without ``skip``.

    A matrix of closeness (larger is closer) finds a short list that surely holds the answer:
    all columns as close as the k-th best group of columns, with room for rounding, which is that of
    single precision where lengths allow it. Distances, ties and order are then settled on that list
    only, in double precision. For COSINE both sides have unit length.
    """
    largest, query_norms = screen.largest, _lengths(query)
    if not np.isfinite(largest) or not np.isfinite(query_norms).all():
        raise ValueError("a vector without finite length reached the search")
    single = screen.small is not None and 1e-15 < query_norms.min() and query_norms.max() < 1e15
    closeness = query.astype(np.float32) @ screen.small.T if single else query @ screen.rows(slice(None)).T
    # A product of d rounded terms is off by less than (d + 4) units of the lengths' product.
    off = 2.0 * (query.shape[1] + 4) * np.finfo(closeness.dtype).eps
    slack = (2.0 * 10.0**-TIE_DIGITS + off) * query_norms * largest
    if distance == "EUCLIDEAN":
        closeness *= 2.0
        closeness -= (screen.lengths**2).astype(closeness.dtype)
        slack = (4.0 * 10.0**-TIE_DIGITS + 2.0 * off) * (query_norms + largest) ** 2
    closeness[skip] = -np.inf
    rows, cols = _short_list(closeness, k, slack)
    del closeness
    dist = np.empty(len(rows))
    for at in range(0, len(rows), _ROWS):  # a few vectors at a time
        q, b = query[rows[at : at + _ROWS]], screen.rows(cols[at : at + _ROWS])
        if distance == "EUCLIDEAN":  # the product form loses digits for near copies
            dist[at : at + _ROWS] = _lengths(q - b)
        else:
            dist[at : at + _ROWS] = -np.einsum("ij,ij->i", q, b)
    if distance == "COSINE":
        dist = np.clip(1.0 + dist, 0.0, 2.0)
    key = np.round(dist, TIE_DIGITS) if distance == "COSINE" else _significant(dist, TIE_DIGITS)
    key = key + 0.0  # no negative zero
    order = np.lexsort((cols, key, rows))
    rows, cols, dist, key = rows[order], cols[order], dist[order], key[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(query)))[rows]
    best = place < k
    return rows[best], cols[best], dist[best], key[best]


def _significant(values: np.ndarray, digits: int) -> np.ndarray:
    """Values rounded to a number of significant digits."""
    size = np.abs(values)
    power = np.floor(np.log10(np.where(size > 0, size, 1.0)))
    unit = 10.0 ** (power - digits + 1)
    return np.where(unit > 0, np.round(values / np.where(unit > 0, unit, 1.0)) * unit, values)


def _short_list(closeness, k, slack):
    """Finite places at most ``slack`` below a value that k groups of columns reach; a group is every G-th column.

    Only the groups that reach it are looked into, so the matrix is read once.
    """
    n, m = closeness.shape
    width = m // _GROUP
    if width < k:
        rows, cols = np.nonzero(closeness >= _lowest(closeness, k, slack)[:, None])
    else:
        whole = width * _GROUP
        maxima = closeness[:, :whole].reshape(n, _GROUP, width).max(axis=1)
        if whole < m:
            maxima = np.hstack([maxima, closeness[:, whole:].max(axis=1, keepdims=True)])
        lowest = _lowest(maxima, k, slack)
        rows, cols = _members(closeness, *np.nonzero(maxima >= lowest[:, None]), lowest, width)
    kept = np.isfinite(closeness[rows, cols])
    return rows[kept], cols[kept]


def _lowest(values, k, slack):
    limit = _kth_largest(values, k) - slack
    return np.nextafter(limit.astype(values.dtype), -np.inf, dtype=values.dtype)


def _members(closeness, rows, groups, lowest, width):
    """Row and column of the members of groups that are no less than ``lowest``; the last group is the rest of the columns."""
    found = []
    for place in range(_GROUP):  # one member of every group at a time
        cols = np.where(groups < width, groups + place * width, width * _GROUP + place)
        there = np.flatnonzero(cols < closeness.shape[1])
        there = there[closeness[rows[there], cols[there]] >= lowest[rows[there]]]
        found.append((rows[there], cols[there]))
    rows, cols = (np.concatenate(c) for c in zip(*found, strict=True))
    return rows, cols


def _kth_largest(values, k):
    at = max(values.shape[1] - k, 0)
    return np.partition(values, at, axis=1)[:, at]


def search_matches(
    matches: DataFrame, queries: DataFrame, base: DataFrame, query_id: str = "user_id", base_id: str = "item_id"
) -> DataFrame:
    """Search output with the full rows of both sides as ``query`` and ``base`` structs."""
    q = queries.select(F.col(query_id).alias("_q"), F.struct("*").alias("query"))
    b = base.select(F.col(base_id).alias("_b"), F.struct("*").alias("base"))
    return (
        matches.join(q, F.col(query_id) == F.col("_q"))
        .join(b, F.col(base_id) == F.col("_b"))
        .select("distance", "rank", "query", "base")
    )
