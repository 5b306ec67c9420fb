"""Vector code compression: product codes whose codebooks come from exact ball k-means on integers.

Vectors are cut into equal parts; every part position has its own codebook. Between two rounds an
entry and the parts assigned to it form a ball. Once the entries have moved, a part at distance d of
its own entry can only be nearer to (or as near as) entries within 2 d of that entry:

* the ball's radius (its largest d) bounds the neighbour entries that matter to any of its parts;
* parts with 2 d below the distance to the nearest neighbour form the stable core and stay;
* the other parts fall into rings by the number of neighbours within 2 d, and meet those only.

All values are integers, compared as squares, so ties are real ties and go to the lower index.
Between rounds the vectors and their codes are a written table; every task adds up its own parts per
entry, and only these sums are shuffled. Codebooks are ``parts * entries * width`` numbers: they reach
the driver and every task, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustara.llm.common import quoted
from gustara.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS_AT_ONCE = 1 << 14
RINGS = (1, 4, 16, 64)  # a part with more neighbours than RINGS[i] belongs to a ring further out
VECTOR, SUMS = 0, 1
# Arrow types of the columns of a round; those of id and label come with the data.
COLUMNS = [None, None, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]``: the entries of part ``p`` as rows of integers."""

    entries: list[np.ndarray]

    def numbers(self) -> list[int]:
        """All components by part, entry and position."""
        return [int(v) for part in self.entries for v in part.ravel()]


class Balls:
    """The entries of one part, each with all entries in ascending order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.float64)
        self.norms = (self.entries**2).sum(1)
        gaps = self.norms[:, None] - 2.0 * self.entries @ self.entries.T + self.norms
        self.near = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.near, 1)

    def distances(self, rows: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Squared distances of all rows to some entries."""
        return (rows**2).sum(1)[:, None] - 2.0 * rows @ self.entries[among].T + self.norms[among]

    def own(self, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distance of every row to the entry of its code."""
        return ((rows - self.entries[codes]) ** 2).sum(1)

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of rows that belong to no ball yet, and the squared distance."""
        found = self.distances(rows, np.arange(len(self.entries)))
        codes = found.argmin(1)
        return codes, found[np.arange(len(rows)), codes]

    def reassign(self, rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of rows that lie in balls, by stable cores and rings."""
        best, dist = codes.copy(), self.own(rows, codes)
        by_ball = np.argsort(codes, kind="stable")
        cuts = np.searchsorted(codes[by_ball], np.arange(len(self.entries) + 1))
        for ball in np.flatnonzero(np.diff(cuts)):
            members = by_ball[cuts[ball] : cuts[ball + 1]]
            neighbours = self.gaps[ball][: np.searchsorted(self.gaps[ball], 4.0 * dist[members].max(), "right")]
            within = np.searchsorted(neighbours, 4.0 * dist[members], "right")
            ring = np.searchsorted(RINGS, within)  # 0: only its own entry is within reach
            for r in range(1, len(RINGS) + 1):
                inside = members[ring == r]
                if inside.size:
                    among = np.sort(self.near[ball][: within[ring == r].max()])
                    found = self.distances(rows[inside], among)
                    first = found.argmin(1)
                    best[inside], dist[inside] = among[first], found[np.arange(inside.size), first]
        return best, dist


def _prepared(vectors: DataFrame, vec_id: str, vector: str, label: str | None, scale: int) -> DataFrame:
    given = F.col(quoted(vector))
    numbers = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.coalesce(given.isNotNull() & (F.size(given) > 0) & numbers, F.lit(False)))
    named = F.col(quoted(label)) if label is not None else F.lit(None).cast("int")
    whole = F.transform(given, lambda x: F.floor(x.cast("double") * float(scale)))
    return kept.select(F.col(quoted(vec_id)).alias("id"), named.alias("label"), whole.alias("x"))


def _check_widths(rows: DataFrame, parts: int) -> int:
    """The common number of components; 0 without rows."""
    low, high, largest = rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if low is None:
        return 0
    if low != high or low % parts:
        raise ValueError(f"vectors of {low} to {high} components cannot be cut into {parts} equal parts")
    # Squares, products and their sums must be whole numbers that a double holds exactly.
    if 4 * int(largest) ** 2 * (low // parts) >= 2**53:
        raise ValueError(f"components up to {largest} are too large for exact squared distances")
    return low


def _first_entries(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    found = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # bounded by the parameter
    whole = np.array([r["x"] for r in found], np.int64)
    return Codebooks([part.copy() for part in np.split(whole, parts, axis=1)])


def _assign_schema(rows: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("label", rows.schema["label"].dataType),
            T.StructField("x", T.ArrayType(T.LongType())),
            T.StructField("codes", T.ArrayType(T.IntegerType())),
            T.StructField("error", T.LongType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("entry", T.IntegerType()),
            T.StructField("sums", T.ArrayType(T.LongType())),
            T.StructField("kind", T.IntegerType()),
        ]
    )


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width, pa.array(values.ravel(), kind))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assign(rows: DataFrame, books: Codebooks, keep_vectors: bool = True) -> DataFrame:
    """Every row with its codes and error, and per task the sums of its parts by entry (``kind`` SUMS).

    Rows with ``codes`` are searched from their balls, rows without among all entries. A row of sums
    ends with the number of parts added up. ``keep_vectors`` False leaves out vectors and sums.
    """
    schema, entries = _assign_schema(rows), books.entries
    fed = rows.select("id", "label", "x", *(["codes"] if "codes" in rows.columns else []))

    def batch(columns: list[pa.Array], kind: int) -> pa.RecordBatch:
        n = next(len(c) for c in columns if c is not None)
        filled = [pa.nulls(n, t) if c is None else c for c, t in zip(columns, COLUMNS, strict=True)]
        return pa.RecordBatch.from_arrays([*filled, pa.array(np.full(n, kind), pa.int32())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(e) for e in entries]
        sums = [np.zeros((len(e), e.shape[1] + 1), np.int64) for e in entries]
        ids = labels = None
        for given in _gathered(batches):
            ids, labels = given.column("id"), given.column("label")
            whole = _matrix(given.column("x"))
            before = _matrix(given.column("codes")) if "codes" in given.schema.names else None
            codes, error = np.empty((len(whole), len(balls)), np.int64), np.zeros(len(whole))
            for p, part in enumerate(np.split(whole, len(balls), axis=1)):
                if before is None:
                    codes[:, p], dist = balls[p].search(part.astype(np.float64))
                else:
                    codes[:, p], dist = balls[p].reassign(part.astype(np.float64), before[:, p].astype(np.int64))
                error += dist
                np.add.at(sums[p][:, :-1], codes[:, p], part)
                sums[p][:, -1] += np.bincount(codes[:, p], minlength=len(sums[p]))
            x = given.column("x") if keep_vectors else None
            yield batch([ids, labels, x, _lists(codes, pa.int32()), pa.array(error.astype(np.int64)), None, None, None], VECTOR)
        if keep_vectors and ids is not None:
            none = [pa.nulls(1, ids.type), pa.nulls(1, labels.type)]
            for p, part in enumerate(sums):
                used = np.flatnonzero(part[:, -1])
                empty = [n.take(pa.array(np.zeros(used.size, np.int64))) for n in none]
                place = [pa.array(np.full(used.size, p), pa.int32()), pa.array(used, pa.int32())]
                yield batch([*empty, None, None, None, *place, _lists(part[used], pa.int64())], SUMS)

    return fed.mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ROWS_AT_ONCE, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS_AT_ONCE:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _moved(state: DataFrame, books: Codebooks) -> Codebooks:
    """Entries replaced by the floored mean of their parts; entries without parts stay."""
    cells = state.where(F.col("kind") == SUMS).select("part", "entry", F.posexplode("sums").alias("place", "value"))
    total = cells.groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))
    listed = total.groupBy("part", "entry").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("cells"))
    entries = [e.copy() for e in books.entries]
    for row in listed.collect():  # one row per entry, bounded by the parameters
        *parts, count = [c["value"] for c in row["cells"]]
        entries[row["part"]][row["entry"]] = [v // count for v in parts]
    return Codebooks(entries)


def compress_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | None = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """(id, label, codes, error) per kept vector, and the codebooks the codes refer to.

    A component x counts as ``floor(scale * x)``. Vectors that are NULL, empty or hold a NULL or
    non-finite component are dropped; equal and repeated rows are all kept, and so are NULL ids
    (they come last in the order of ids) and NULL labels. Other columns are not looked at. Each
    codebook starts as that part of the ``entries`` smallest ids (fewer rows: fewer entries; equal
    ids: by vector). After ``rounds`` rounds parts are assigned once more; ``error`` is the sum of the
    final squared distances. An empty table gives no rows and no entries. Vectors of different
    lengths, or lengths that ``parts`` does not divide, are an error, as are components whose
    squares a double cannot hold exactly.
    """
    rows = materialize(_prepared(vectors, vec_id, vector, label, scale), "vectors")
    if not _check_widths(rows, parts):
        nothing = [F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("bigint").alias("error")]
        return rows.select("id", "label", *nothing), Codebooks([])
    books = _first_entries(rows, parts, entries)
    for n in range(rounds):
        state = materialize(assign(rows, books), f"balls-{n}", partition_by="kind")
        rows = state.where(F.col("kind") == VECTOR)
        books = _moved(state, books)
    coded = materialize(assign(rows, books, keep_vectors=False).select("id", "label", "codes", "error"), "codes")
    return coded, books


def restore(coded: DataFrame, books: Codebooks, out: str = "vector", scale: int = SCALE) -> DataFrame:
    """(id, label, ``out``): the vectors that the codes stand for; NULL codes give NULL."""
    tables = [part / scale for part in books.entries]
    fed = coded.select("id", "label", "codes")
    schema = T.StructType([*fed.schema.fields[:2], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            codes = given.column("codes").to_pylist()
            whole = [None if c is None else np.concatenate([t[i] for t, i in zip(tables, c, strict=True)]) for c in codes]
            vectors = pa.array(whole, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([given.column("id"), given.column("label"), vectors], names=schema.names)

    return fed.mapInArrow(run, schema)
