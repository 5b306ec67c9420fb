"""Boosting rounds inside tasks that keep their rows.

All rounds are one barrier stage: every task reads its users' rows once, keeps their bins as columns of
bytes and goes through all trees with them. A job per tree level would start thousands of jobs and read
the rows again in each.

Tasks meet through files in the shared folder (a barrier of Spark's own takes a second per call). Of the
histograms of a level every task adds up those of its share of the features and offers its best splits;
all tasks then take the same ones. Of two sibling nodes the one with less curvature is counted, the other
is what its parent leaves.

Rows of a user lie in one task. Users with a large share of all rows are dealt over all tasks, which
exchange the first rows of these users and what those get back.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs

CHUNK = 1 << 14  # rows whose gradients or moves are held at a time
PLACES = 1 << 16  # rows whose histogram places are held at a time
SAME = 1e-9  # gains that differ by a smaller share are equal: the first split is taken
WAIT_SECONDS = 3600.0
LAST = np.iinfo(np.int64).max


def reach(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder as Python reaches it; an error if only Spark can."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(folder)


class Exchange:
    """Messages between the tasks of one stage attempt. A task removes a message when all have read it."""

    def __init__(self, folder: str, rank: int, n: int):
        self.rank, self.n, self.step = rank, n, 0
        if n > 1:
            self.fs, self.root = reach(folder)
            self.fs.create_dir(self.root, recursive=True)

    def _path(self, step: int, rank: int) -> str:
        return f"{self.root}/{step}-{rank}"

    def swap(self, parts: Sequence[bytes]) -> list[bytes]:
        """Part i goes to task i; the parts sent to this task, by sender."""
        if self.n == 1:
            return [parts[0]]
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
        path = self._path(self.step, self.rank)
        with self.fs.open_output_stream(f"{path}.part") as out:
            out.write(ends.tobytes() + b"".join(parts))
        self.fs.move(f"{path}.part", path)
        found = [parts[self.rank] if r == self.rank else self._read(self._path(self.step, r)) for r in range(self.n)]
        if self.step:  # everyone who wrote this step has read the last one
            self.fs.delete_file(self._path(self.step - 1, self.rank))
        self.step += 1
        return found

    def _read(self, path: str) -> bytes:
        pause, until = 2e-4, time.monotonic() + WAIT_SECONDS
        while True:
            try:
                with self.fs.open_input_file(path) as given:
                    here, end = np.frombuffer(given.read_at(16, 8 * self.rank), np.int64)
                    return given.read_at(int(end - here), 8 * (self.n + 1) + int(here))
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise TimeoutError(f"no message {os.path.basename(path)} from another task") from None
                time.sleep(pause)
                pause = min(1.3 * pause, 0.02)

    def gather(self, array: np.ndarray) -> np.ndarray:
        """The arrays of all tasks, equal in shape, by task."""
        found = self.swap([np.ascontiguousarray(array).tobytes()] * self.n)
        return np.stack([np.frombuffer(f, array.dtype).reshape(array.shape) for f in found])


class Rows:
    """The rows of a task, in the order of user and number.

    ``batches`` hold user_id, rid, gain and bins in that order; ``hot`` are the users whose other rows are
    in other tasks. ``kept`` are the features that are not equal in all rows of all tasks.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch], n_features: int, hot: Sequence[str], exchange: Exchange):
        rids, gains, bins, fresh, names, last = [], [], [], [], [], None
        for given in batches:
            if not given.num_rows:
                continue
            user = given.column(0).dictionary_encode()
            code = user.indices.to_numpy()
            new = np.concatenate([[True], code[1:] != code[:-1]])
            words = user.dictionary.to_pylist()
            new[0] = words[code[0]] != last
            last = words[code[-1]]
            names += [words[c] for c in code[new]]
            fresh.append(new)
            rids.append(given.column(1).to_numpy())
            gains.append(given.column(2).to_numpy())
            ends = np.frombuffer(given.column(3).buffers()[1], np.int32)[given.column(3).offset :][: given.num_rows + 1]
            flat = np.frombuffer(given.column(3).buffers()[2], np.uint8)[ends[0] : ends[-1]]
            bins.append(np.ascontiguousarray(flat.reshape(given.num_rows, n_features).T))
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.rid, self.gain = joined(rids, np.int64), joined(gains, float)
        self.n = len(self.rid)
        least = np.array([part.min(1) for part in bins] or np.full((1, n_features), 255)).min(0)
        most = np.array([part.max(1) for part in bins] or np.zeros((1, n_features))).max(0)
        edges = exchange.gather(np.stack([least, most]).astype(np.int64))
        self.kept = np.flatnonzero(edges[:, 0].min(0) < edges[:, 1].max(0))
        self.bins = np.empty((len(self.kept), self.n), np.uint8)
        low, bins = 0, bins[::-1]
        while bins:  # a batch is let go as soon as it is copied
            part = bins.pop()
            self.bins[:, low : low + part.shape[1]] = part[self.kept]
            low += part.shape[1]
        self.starts = np.flatnonzero(joined(fresh, bool))
        self.sizes = np.diff(np.append(self.starts, self.n))
        self.owner = np.repeat(np.arange(len(self.starts), dtype=np.int32), self.sizes)
        number = {u: i for i, u in enumerate(names)}
        self.hot = np.array([number.get(u, -1) for u in hot], np.int64)  # place of each hot user here, if it has rows

    def first(self, value: np.ndarray, k: int) -> np.ndarray:
        """Rows of the k largest values of every user, equal ones in row order; -1 where there are fewer."""
        out = np.full((len(self.starts), k), -1)
        left = value.copy()
        for j in range(k if self.n else 0):
            best = np.maximum.reduceat(left, self.starts)
            at = np.flatnonzero(left == np.repeat(best, self.sizes))
            user = self.owner[at]
            new = np.concatenate([[True], user[1:] != user[:-1]])
            at, user = at[new], user[new]
            there = best[user] > -np.inf
            out[user[there], j] = at[there]
            left[at] = -np.inf
        return out


def _tops(rows: Rows, value: np.ndarray, k: int, exchange: Exchange):
    """First rows of every user by ``value``: rows here (-1: none, or in another task), their gains and values (NaN: none)."""
    at = rows.first(value, k)
    gain, top = (np.where(at >= 0, x[np.maximum(at, 0)] if rows.n else np.nan, np.nan) for x in (rows.gain, value))
    if len(rows.hot):
        here = rows.hot >= 0
        mine = np.full((3, len(rows.hot), k), np.nan)
        number, place = np.full((len(rows.hot), k), LAST), np.full((len(rows.hot), k), -1)
        mine[0, here], mine[1, here], place[here] = gain[rows.hot[here]], top[rows.hot[here]], at[rows.hot[here]]
        number[place >= 0] = rows.rid[place[place >= 0]]
        mine[2] = exchange.rank
        values, numbers = exchange.gather(mine), exchange.gather(number)
        for h in np.flatnonzero(here):
            g, v, task = (values[:, c, h].ravel() for c in range(3))
            order = np.lexsort((numbers[:, h].ravel(), np.where(np.isnan(v), np.inf, -v)))[:k]
            user = rows.hot[h]
            gain[user], top[user] = g[order], v[order]
            own = (task[order] == exchange.rank) & ~np.isnan(v[order])
            at[user] = np.where(own, place[h][order % k], -1)
    return at, gain, top


def _ideals(rows: Rows, k: int, exchange: Exchange) -> np.ndarray:
    """Largest DCG of every user; 0 where a gain is no number, so that the user pulls nothing."""
    unknown = np.isnan(rows.gain)
    rows.gain[unknown] = 0.0
    bad = np.zeros(len(rows.starts))
    np.maximum.at(bad, rows.owner[unknown], 1.0)
    if len(rows.hot):
        here = rows.hot >= 0
        flags = np.zeros(len(rows.hot))
        flags[here] = bad[rows.hot[here]]
        bad[rows.hot[here]] = exchange.gather(flags).max(0)[here]
    gains = _tops(rows, rows.gain, k, exchange)[1]
    ideal = np.nansum(gains / np.log2(np.arange(k) + 2.0), axis=1)
    return np.where(bad > 0, 0.0, ideal)


def _gradients(rows: Rows, score: np.ndarray, ideal: np.ndarray, k: int, exchange: Exchange, lambdas) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of every row, with what first rows get from the others."""
    at, gain, top = _tops(rows, score, k, exchange)
    place = np.full(rows.n, -1, np.int8)
    for j in range(k):
        place[at[at[:, j] >= 0, j]] = j
    g, h = np.empty(rows.n), np.empty(rows.n)
    back = np.zeros((2, k, len(rows.starts)))
    gain, top = np.ascontiguousarray(gain.T), np.ascontiguousarray(top.T)
    for low in range(0, rows.n, CHUNK):
        part = slice(low, low + CHUNK)
        user = rows.owner[part]
        g[part], h[part], *told = lambdas(rows.gain[part], score[part], place[part], gain[:, user].T, top[:, user].T, ideal[user])
        edges = np.flatnonzero(np.concatenate([[True], user[1:] != user[:-1]]))
        for c, x in enumerate(told):
            back[c, :, user[0] : user[-1] + 1] += np.add.reduceat(x.T, edges, axis=1)
    if len(rows.hot):
        here = rows.hot >= 0
        mine = np.zeros((2, k, len(rows.hot)))
        mine[..., here] = back[..., rows.hot[here]]
        back[..., rows.hot[here]] = exchange.gather(mine).sum(0)[..., here]
    for j in range(k):
        user = np.flatnonzero(at[:, j] >= 0)
        g[at[user, j]] += back[0, j, user]
        h[at[user, j]] += back[1, j, user]
    return g, h


def _counted(rows: Rows, at: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: np.ndarray, n_nodes: int, width: int) -> np.ndarray:
    """Sums of (g, h) of the task's rows by feature, node of ``nodes`` and bin."""
    slot_of = np.full(n_nodes, -1)
    slot_of[nodes] = np.arange(len(nodes))
    out = np.zeros((len(rows.bins), 2, len(nodes) * width))
    for low in range(0, rows.n, PLACES):
        part = slice(low, low + PLACES)
        slot = slot_of[at[part]]
        live = np.flatnonzero(slot >= 0)
        if not live.size:
            continue
        whole = live.size == slot.size
        first, gl, hl = (slot if whole else slot[live]) * width, *(x[part] if whole else x[part][live] for x in (g, h))
        for f, column in enumerate(rows.bins):
            place = first + (column[part] if whole else column[part][live])
            out[f, 0] += np.bincount(place, gl, minlength=len(nodes) * width)
            out[f, 1] += np.bincount(place, hl, minlength=len(nodes) * width)
    return out.reshape(len(rows.bins), 2, len(nodes), width)


def _loss(sums: np.ndarray, penalty: float) -> np.ndarray:
    return sums[0] ** 2 / (sums[1] + penalty)


def _offers(sums: np.ndarray, first: int, whole: np.ndarray, penalty: float, least: float) -> np.ndarray:
    """Best split of each node on some features: loss taken, feature, cut, and (g, h) of the left side.

    ``sums``: (feature, 2, node, bin); ``first`` is the number of the first feature; ``whole``: (2, node).
    """
    n_features, _, n, _ = sums.shape
    out = np.zeros((n, 5))
    if not n_features:
        return out
    left = np.cumsum(sums[..., :-1], axis=3)
    lg, lh = left[:, 0], left[:, 1]  # (feature, node, cut)
    rg, rh = whole[0][:, None] - lg, whole[1][:, None] - lh
    allowed = (lh >= least) & (rh >= least)
    gain = np.where(allowed, lg * lg / (lh + penalty) + rg * rg / (rh + penalty) - _loss(whole, penalty)[:, None], 0.0)
    most = gain.max(2)  # (feature, node)
    every, feature = np.arange(n), (most >= (1 - SAME) * most.max(0)).argmax(0)
    cut = (gain[feature, every] >= (1 - SAME) * most[feature, every][:, None]).argmax(1)
    out[:, 0], out[:, 1], out[:, 2] = gain[feature, every, cut], first + feature, cut
    out[:, 3:] = left[feature, :, every, cut]
    return out


def grow(rows: Rows, g: np.ndarray, h: np.ndarray, tree, gains: np.ndarray, width: int, penalty: float, least: float, exchange: Exchange) -> np.ndarray:
    """Fill ``tree``, level by level, in numbers of the kept features; the node that every row ends in."""
    n_features, n_nodes = len(rows.bins), len(tree.value)
    cuts = np.linspace(0, n_features, exchange.n + 1).astype(int)  # features whose sums each task adds up
    mine = slice(cuts[exchange.rank], cuts[exchange.rank + 1])
    at, flat = np.zeros(rows.n, np.int64), rows.bins.ravel()
    nodes, build, held = np.array([0]), np.array([0]), None
    whole = exchange.gather(np.array([[g.sum()], [h.sum()]])).sum(0)
    for level in range(tree.depth + 1):
        tree.value[nodes] = -whole[0] / (whole[1] + penalty)
        if level == tree.depth:
            break
        counted = _counted(rows, at, g, h, build, n_nodes, width)
        shape = (mine.stop - mine.start, 2, len(build), width)
        parts = [counted[cuts[r] : cuts[r + 1]].tobytes() if exchange.n > 1 else counted for r in range(exchange.n)]
        if exchange.n > 1:
            fresh = np.zeros(shape)
            for part in exchange.swap(parts):
                fresh += np.frombuffer(part).reshape(shape)
        else:
            fresh = counted
        if held is None:
            sums = fresh
        else:  # nodes are pairs of siblings; one of each was counted
            sums = np.empty((shape[0], 2, len(nodes), width))
            other = np.where(build % 2 == 1, build + 1, build - 1)
            sums[:, :, np.searchsorted(nodes, build)] = fresh
            sums[:, :, np.searchsorted(nodes, other)] = held - fresh
        offers = exchange.gather(_offers(sums, mine.start, whole, penalty, least))  # (task, node, 5)
        taken = offers[(offers[..., 0] >= (1 - SAME) * offers[..., 0].max(0)).argmax(0), np.arange(len(nodes))]
        split = taken[:, 0] > 1e-9
        parents, chosen = nodes[split], taken[split]
        tree.feature[parents], tree.cut[parents] = chosen[:, 1], chosen[:, 2]
        np.add.at(gains, chosen[:, 1].astype(int), chosen[:, 0])
        if not parents.size:
            break
        left = chosen[:, 3:].T
        right = whole[:, split] - left
        whole = np.stack([left, right], axis=2).reshape(2, -1)
        nodes = np.stack([2 * parents + 1, 2 * parents + 2], axis=1).ravel()
        build = np.where(left[1] <= right[1], 2 * parents + 1, 2 * parents + 2)
        held = sums[:, :, split]
        offset = tree.feature * rows.n
        for low in range(0, rows.n, CHUNK):
            here = at[low : low + CHUNK]
            column = offset.take(here)
            move = np.flatnonzero(column >= 0)
            node, place = (here, np.arange(low, low + here.size)) if move.size == here.size else (here[move], low + move)
            bins = flat.take((column if move.size == here.size else column[move]) + place)
            here[move] = 2 * node + 1 + (bins > tree.cut.take(node))
    return at


def boost(rows: Rows, trees: int, make_tree, gains: np.ndarray, k: int, width: int, step: float, penalty: float, least: float, exchange: Exchange, lambdas) -> Iterator:
    """Trees one after the other; ends early if no split takes away loss."""
    score, ideal = np.zeros(rows.n), _ideals(rows, k, exchange)
    for _ in range(trees):
        tree = make_tree()
        g, h = _gradients(rows, score, ideal, k, exchange, lambdas)
        at = grow(rows, g, h, tree, gains, width, penalty, least, exchange)
        if tree.feature[0] < 0:
            return
        score += step * tree.value[at]
        yield tree
