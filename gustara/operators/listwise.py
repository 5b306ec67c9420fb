"""Boosted trees for rankings: lambda gradients of NDCG@k per user, histogram splits per level.

A round scores all rows and takes the first k of every user. A swap of two rows changes NDCG@k only if
one of them is among these, so every row meets its user's k first rows and no other: the pairs of a
user with a third of all rows are spread over tasks, and none is left out. What a row below the first
k adds to one of them is summed per batch and enters the histograms as a row of its own, with the
first row's bins and its part of the gradient.

A tree grows by levels. Each level is one pass: tasks add up gradients by node, feature and bin, and
the sums (nodes x features x bins) decide the splits. Features are cut into bins once, at quantiles.

All rounds run inside one stage whose tasks keep their rows (``resident``). Where tasks cannot run side by
side or share no folder, or a task's rows would be too many to keep, a level is a job of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustara.operators import resident
from gustara.operators.features import feature_columns
from gustara.operators.ordering import top_k
from gustara.operators.skew import attach
from gustara.session import materialize, work_dir

BINS = 64  # bins of known values; bin 0 holds the missing ones
TASK_ROWS = 1 << 16  # rows that are worth a task of their own
KEPT_ROWS = 1 << 23  # rows a task keeps at most, at about 80 bytes and one per feature
SCORED = 1 << 13  # rows that go through all trees together
STATE = "user_id string, rid bigint, gain double, score double, bins binary"
PULLED = "user_id string, rid bigint, gain double, score double, bins binary, own boolean, g double, h double"


@dataclass
class Tree:
    """A complete binary tree: children of node n are 2n + 1 and 2n + 2; feature -1 marks a leaf."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.cut, self.value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)

    def node(self, bins: np.ndarray) -> np.ndarray:
        """The node that every row of bins ends in."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(self.depth):
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not inner.size:
                break
            here = at[inner]
            at[inner] = 2 * here + 1 + (bins[inner, self.feature[here]] > self.cut[here])
        return at


@dataclass
class ListwiseRanker:
    features: list[str]
    edges: list[np.ndarray]
    step: float
    trees: list[Tree] = field(default_factory=list)
    gains: np.ndarray | None = None  # loss taken away by the splits on each feature

    def importances(self) -> list[float]:
        total = self.gains.sum() if self.gains is not None else 0.0
        return [float(g / total) if total > 0 else 0.0 for g in (self.gains if self.gains is not None else np.zeros(len(self.features)))]

    def bins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Bins of feature columns: 0 where a value is missing."""
        found = [np.where(np.isnan(x), 0, np.searchsorted(e, x, "left") + 1) for x, e in zip(columns, self.edges, strict=True)]
        return np.stack(found, axis=1).astype(np.uint8)

    def score(self, bins: np.ndarray, packed: list[tuple[int, np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        packed = self.packed() if packed is None else packed
        out = np.zeros(len(bins))
        for low in range(0, len(bins), SCORED):
            some = bins[low : low + SCORED]
            flat, row = np.ascontiguousarray(some).ravel(), np.arange(len(some), dtype=np.int64) * bins.shape[1]
            for depth, code, value in packed:
                at = np.zeros(len(some), np.int64)
                for _ in range(depth):
                    here = code.take(at)
                    at = 2 * at + 1 + (flat.take(row + (here >> 8)) > (here & 255))
                out[low : low + SCORED] += value.take(at)
        return out

    def packed(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Depth, feature and cut as one number, and step of every tree; a leaf hands its value down to the left."""
        out = []
        for tree in self.trees:
            value = self.step * tree.value
            for level in range(tree.depth):
                low, high = 2**level - 1, 2 ** (level + 1) - 1
                below = value[2 * low + 1 : 2 * high + 1 : 2]  # left children
                below[:] = np.where(tree.feature[low:high] < 0, value[low:high], below)
            inner = tree.feature >= 0
            out.append((tree.depth, np.where(inner, 256 * tree.feature + tree.cut, 255), value))
        return out


def lambda_gradients(gain, score, place, top_gain, top_score, ideal):
    """Gradient and curvature of every row against its user's first rows, and what those get back.

    ``gain``, ``score``, ``place`` (0-based place among the first rows, -1 below them) and ``ideal`` (the
    user's largest DCG) are per row; ``top_gain`` and ``top_score`` are matrices of the first rows, NaN
    where there are fewer. The last two results are matrices, zero for rows that are among the first
    (they meet the others from their own side).
    """
    n, k = top_gain.shape
    discount = 1.0 / np.log2(np.arange(k) + 2.0)
    mine = np.where(place >= 0, discount[np.maximum(place, 0)], 0.0)
    share = np.where(ideal > 0, 1.0, 0.0) / np.where(ideal > 0, ideal, 1.0)
    below = place < 0
    g, h, back_g, back_h = np.zeros(n), np.zeros(n), np.empty((k, n)), np.empty((k, n))
    for j in range(k):  # a row meets itself without effect
        there = ~np.isnan(top_gain[:, j])
        more = np.where(there, gain - top_gain[:, j], 0.0)
        ahead = np.where(there, score - top_score[:, j], 0.0)
        wrong = 1.0 / (1.0 + np.exp(np.clip(ahead, -500, 500)))  # if this row is to be first
        change = more * (np.abs(mine - discount[j]) * share)
        pull, bend = -change * np.where(more > 0, wrong, 1.0 - wrong), np.abs(change) * (wrong * (1.0 - wrong))
        g += pull
        h += bend
        np.multiply(pull, -1.0 * below, out=back_g[j])
        np.multiply(bend, below, out=back_h[j])
    return g, h, back_g.T, back_h.T


def fit_listwise(
    matrix: DataFrame,
    label: str = "rating",
    k: int = 5,
    rounds: int = 20,
    max_depth: int = 5,
    step: float = 0.1,
    penalty: float = 1.0,
    least_curvature: float = 1e-3,
) -> ListwiseRanker:
    """Fit on (user_id, ``label``, features) rows; a label counts as 2 ** label - 1.

    Missing features go to a bin of their own; rows without a user or label are left out. Equal
    scores are placed by a row number, which is a hash of the row, so a fit repeats itself. Users whose
    labels are all equal pull nothing. An empty matrix gives a model without trees.
    """
    features = feature_columns(matrix)
    rows = matrix.where(F.col("user_id").isNotNull() & F.col(label).isNotNull())
    quantiles = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(_number(c)), _number(c)), quantiles, 10_000).alias(c) for c in features]).first()
    ranker = ListwiseRanker(features, [np.unique(np.array(v or [], float)) for v in found], step, gains=np.zeros(len(features)))
    state = materialize(_binned(rows, ranker, label), "binned")
    if tasks := _tasks(state):
        _by_tasks(state, ranker, tasks, k, rounds, max_depth, penalty, least_curvature)
    else:
        _by_jobs(state, ranker, k, rounds, max_depth, penalty, least_curvature)
    return ranker


def _tasks(state: DataFrame) -> int:
    """Number of tasks that keep the rows; 0 if they cannot."""
    spark, n_rows = state.sparkSession, state.count()
    if n_rows <= TASK_ROWS:
        return 1
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    try:
        resident.reach(work_dir(spark))
    except (OSError, ValueError, pa.ArrowException):
        return 0
    scheduler = spark.sparkContext._jsc.sc()
    slots = scheduler.maxNumConcurrentTasks(scheduler.resourceProfileManager().defaultResourceProfile())
    tasks = min(slots, -(-n_rows // TASK_ROWS))
    return tasks if tasks and n_rows <= tasks * KEPT_ROWS else 0


def _by_tasks(state: DataFrame, ranker: ListwiseRanker, tasks: int, k: int, rounds: int, depth: int, penalty: float, least: float) -> None:
    """All rounds in one stage; users with over a quarter of a task's share of the rows are dealt over all tasks."""
    hot: list[str] = []
    if tasks > 1:
        sizes = state.groupBy("user_id").count()
        hot = [r["user_id"] for r in sizes.where(F.col("count") > state.count() // (4 * tasks)).orderBy("user_id").collect()]  # below 4 x tasks
    key = F.when(F.col("user_id").isin(hot), F.col("rid")).otherwise(F.xxhash64("user_id"))
    dealt = state.select("user_id", "rid", "gain", "bins").repartition(tasks, key).sortWithinPartitions("user_id", "rid")
    n_features, step = len(ranker.features), ranker.step
    folder = f"{work_dir(state.sparkSession).rstrip('/')}/rounds-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        attempt = BarrierTaskContext.get().allGather(uuid.uuid4().hex)[0] if tasks > 1 else ""
        exchange = resident.Exchange(f"{folder}/{attempt}", number, tasks)
        rows = resident.Rows(batches, n_features, hot, exchange)
        gains, all_gains = np.zeros(len(rows.kept)), np.zeros(n_features)
        for tree in resident.boost(rows, rounds, lambda: Tree(depth), gains, k, BINS + 1, step, penalty, least, exchange, lambda_gradients):
            if number == 0:
                inner, all_gains[rows.kept] = tree.feature >= 0, gains
                feature = np.where(inner, rows.kept[np.where(inner, tree.feature, 0)], -1)
                values = [np.asarray(x).tobytes() for x in (feature.astype(np.int64), tree.cut, tree.value, all_gains)]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["feature", "cut", "value", "gains"])

    try:
        found = dealt.mapInArrow(run, "feature binary, cut binary, value binary, gains binary", barrier=tasks > 1).collect()  # trees
    finally:
        if tasks > 1:
            files, path = resident.reach(folder)
            if files.get_file_info(path).type == resident.fs.FileType.Directory:
                files.delete_dir(path)
    for row in found:  # in the order of task 0
        tree = Tree(depth)
        tree.feature, tree.cut, tree.value = (np.frombuffer(row[c], kind).copy() for c, kind in (("feature", np.int64), ("cut", np.int64), ("value", float)))
        ranker.trees.append(tree)
        ranker.gains = np.frombuffer(row["gains"]).copy()


def _by_jobs(state: DataFrame, ranker: ListwiseRanker, k: int, rounds: int, depth: int, penalty: float, least: float) -> None:
    """All rounds with one job per level."""
    best = top_k(state.select("user_id", "rid", "gain"), ["user_id"], [F.col("gain").desc(), F.col("rid")], k)
    ideal = materialize(best.groupBy("user_id").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("ideal")), "ideal")
    for n in range(rounds):
        pulled = materialize(_pulled(state, ideal, k), f"pulled-{n}")
        tree = _grow(pulled, ranker, depth, penalty, least)
        if tree is None:
            break
        ranker.trees.append(tree)
        if n + 1 < rounds:
            state = materialize(_moved(pulled, tree, ranker.step), f"scored-{n}")


def _number(column: str):
    return F.col(f"`{column}`").cast("double")


def _binned(rows: DataFrame, ranker: ListwiseRanker, label: str) -> DataFrame:
    """Rows of STATE with score 0."""
    numbers = [_number(c).alias(f"f{n}") for n, c in enumerate(ranker.features)]
    # Equal rows get equal numbers but for a count, so that every row has one of its own.
    fed = rows.select(F.col("user_id").cast("string").alias("user_id"), F.pow(F.lit(2.0), F.col(label).cast("double")).alias("gain"), *numbers)
    copies = fed.groupBy(*fed.columns).agg(F.count("*").alias("n"))
    fed = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).drop("n")
    fed = fed.withColumn("rid", F.xxhash64(*fed.columns)).drop("copy")
    fed = fed.select("user_id", "rid", (F.col("gain") - 1.0).alias("gain"), *[f"f{n}" for n in range(len(ranker.features))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            bins = ranker.bins([c.to_numpy(zero_copy_only=False).astype(float) for c in given.columns[3:]])
            yield pa.RecordBatch.from_arrays([*given.columns[:3], pa.array(np.zeros(len(bins))), _packed(bins)], names=["user_id", "rid", "gain", "score", "bins"])

    return fed.mapInArrow(run, STATE)


def _pulled(state: DataFrame, ideal: DataFrame, k: int) -> DataFrame:
    """Rows of PULLED: all rows with their own gradients, and what the first rows get from others."""
    first = top_k(state, ["user_id"], [F.col("score").desc(), F.col("rid")], k)
    lists = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rid", "gain", "score", "bins"))).alias("t"))  # k rows
    # The bins of a user's first rows travel as one value, end to end.
    bins = F.concat(*[F.coalesce(F.get("t.bins", F.lit(i)), F.lit(bytearray())) for i in range(k)]).alias("top_bins")
    lists = lists.select("user_id", *[F.col(f"t.{c}").alias(f"top_{c}") for c in ("rid", "gain", "score")], bins).join(ideal, "user_id")
    columns = ["user_id", "rid", "gain", "score", "bins", "top_rid", "top_gain", "top_score", "top_bins", "ideal"]
    fed = attach(state, lists, "user_id").select(*columns)
    names = T._parse_datatype_string(PULLED).names

    def padded(column: pa.Array, fill) -> np.ndarray:
        sizes = np.diff(column.offsets.to_numpy())
        out = np.full((len(sizes), k), fill)
        out[np.arange(k) < sizes[:, None]] = column.flatten().to_numpy()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            if not given.num_rows:
                continue
            rid, gain, score, ideal = (given.column(c).to_numpy() for c in ("rid", "gain", "score", "ideal"))
            top_rid, top_gain, top_score = padded(given.column("top_rid"), 0), padded(given.column("top_gain"), np.nan), padded(given.column("top_score"), np.nan)
            hit = (top_rid == rid[:, None]) & ~np.isnan(top_gain)
            place = np.where(hit.any(1), hit.argmax(1), -1)
            g, h, back_g, back_h = lambda_gradients(gain, score, place, top_gain, top_score, ideal)
            own = pa.array(np.ones(len(g), bool))
            yield pa.RecordBatch.from_arrays([*given.columns[:5], own, pa.array(g), pa.array(h)], names=names)
            told = np.flatnonzero(back_h.ravel() > 0)
            if told.size:
                ids, at, back = np.unique(top_rid.ravel()[told], return_index=True, return_inverse=True)
                starts, flat = _held(given.column("top_bins"))
                width = np.diff(_held(given.column("bins"))[0][:2])[0]
                places = starts[told[at] // k] + told[at] % k * width
                theirs = _packed(flat[places[:, None] + np.arange(width)])
                sums = [np.bincount(back, b.ravel()[told]) for b in (back_g, back_h)]
                n = len(ids)
                rest = [pa.nulls(n, pa.string()), pa.array(ids), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), theirs]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.zeros(n, bool)), *map(pa.array, sums)], names=names)

    return fed.mapInArrow(run, PULLED)


def _held(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column, read where Arrow holds them."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return ends, np.frombuffer(column.buffers()[2], np.uint8)


def _unpacked(column: pa.Array) -> np.ndarray:
    """Bins of the rows; every row has equally many."""
    ends, flat = _held(column)
    return flat[ends[0] : ends[-1]].reshape(len(column), -1)


def _packed(bins: np.ndarray) -> pa.Array:
    ends = np.arange(len(bins) + 1, dtype=np.int32) * np.int32(bins.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bins))])


def _histograms(pulled: DataFrame, tree: Tree, nodes: np.ndarray, n_features: int) -> np.ndarray:
    """Sums of (g, h) by node, feature and bin, over all rows that end in one of the nodes."""
    shape = (len(nodes), n_features, BINS + 1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for given in batches:
            if not given.num_rows:
                continue
            bins = _unpacked(given.column("bins"))
            at = np.searchsorted(nodes, end := tree.node(bins))
            live = np.flatnonzero((at < len(nodes)) & (nodes[np.minimum(at, len(nodes) - 1)] == end))
            first = at[live] * (BINS + 1)
            by_feature = np.ascontiguousarray(bins[live].T)
            weights = [given.column(name).to_numpy()[live] for name in ("g", "h")]
            for f, mine in enumerate(by_feature):
                place = first + mine
                for c, weight in enumerate(weights):
                    cells = np.bincount(place, weight, minlength=len(nodes) * (BINS + 1))
                    total[:, f, :, c] += cells.reshape(len(nodes), BINS + 1)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total.ravel()[filled])], names=["place", "value"])

    cells = pulled.select("bins", "g", "h").mapInArrow(run, "place bigint, value double")
    out = np.zeros(int(np.prod(shape)))
    for row in cells.groupBy("place").agg(F.sum("value").alias("value")).collect():  # nodes x features x bins
        out[row["place"]] = row["value"]
    return out.reshape(shape)


def _grow(pulled: DataFrame, ranker: ListwiseRanker, depth: int, penalty: float, least: float) -> Tree | None:
    """One tree, level by level; None if no split takes away loss."""
    tree, nodes = Tree(depth), np.array([0])
    for level in range(depth + 1):
        sums = _histograms(pulled, tree, nodes, len(ranker.features))
        whole = sums[:, 0].sum(1)
        tree.value[nodes] = -whole[:, 0] / (whole[:, 1] + penalty)
        if level == depth:
            break
        left = np.cumsum(sums, axis=2)[:, :, :-1]  # split after each bin but the last
        right = whole[:, None, None] - left
        gain = _loss(left, penalty) + _loss(right, penalty) - _loss(whole, penalty)[:, None, None]
        gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), gain, 0.0)
        best = gain.reshape(len(nodes), -1).argmax(1)
        feature, cut = np.divmod(best, BINS)
        took = gain.reshape(len(nodes), -1)[np.arange(len(nodes)), best]
        split = took > 1e-9
        tree.feature[nodes[split]], tree.cut[nodes[split]] = feature[split], cut[split]
        np.add.at(ranker.gains, feature[split], took[split])
        nodes = np.sort(np.concatenate([2 * nodes[split] + 1, 2 * nodes[split] + 2]))
        if not nodes.size:
            break
    return tree if tree.feature[0] >= 0 else None


def _loss(sums: np.ndarray, penalty: float) -> np.ndarray:
    return sums[..., 0] ** 2 / (sums[..., 1] + penalty)


def _moved(pulled: DataFrame, tree: Tree, step: float) -> DataFrame:
    fed = pulled.where("own").select("user_id", "rid", "gain", "score", "bins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            if given.num_rows:
                bins = _unpacked(given.column("bins"))
                score = given.column("score").to_numpy() + step * tree.value[tree.node(bins)]
                yield pa.RecordBatch.from_arrays([*given.columns[:3], pa.array(score), given.column("bins")], names=given.schema.names)

    return fed.mapInArrow(run, STATE)


def score_listwise(ranker: ListwiseRanker, matrix: DataFrame, keep: Sequence[str] = ("user_id", "item_id", "rating", "rating_date")) -> DataFrame:
    """The ``keep`` columns of the matrix with ``score``."""
    numbers = [_number(c).alias(f"f{n}") for n, c in enumerate(ranker.features)]
    fed = matrix.select(*[F.col(f"`{c}`") for c in keep], *numbers)
    schema = T.StructType([*fed.schema.fields[: len(keep)], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = ranker.packed()
        for given in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in given.columns[len(keep) :]]
            score = pa.array(ranker.score(ranker.bins(columns), packed))
            yield pa.RecordBatch.from_arrays([*given.columns[: len(keep)], score], names=schema.names)

    return fed.mapInArrow(run, schema)
