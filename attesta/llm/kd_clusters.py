"""Exact k-means by filtering centroids through kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import textops
from attesta.llm.session import cut
from attesta.llm.topk import EXACT, MOST, WIDE, matrix

#: Vectors of one tree, and of a leaf at most. A tree is one row, so the first bounds what a task holds.
TREE_ROWS, LEAF_ROWS = 8192, 32
_TREE = "ids binary, points binary, width int, bounds binary, low binary, high binary, sums binary"


@dataclass
class Tree:
    """Points in leaf order and, for each node of a complete binary tree (children of i: 2 i + 1 and 2 i + 2), its range of points, its box and its sum."""

    points: np.ndarray
    bounds: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @property
    def first_leaf(self) -> int:
        return len(self.bounds) // 2


def build(points: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, Tree]:
    """The order of the points in their tree, and the tree. Nodes are halved at the median of their widest component."""
    n, depth = len(points), 0
    while n > leaf << depth:
        depth += 1
    order, cuts = np.arange(n), [0, n]
    bounds = [(0, n)]
    for _ in range(depth):
        halved = [0]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            own, middle = order[start:stop], (stop - start) // 2
            if middle:
                rows = points[own]
                axis = int((rows.max(axis=0).astype(float) - rows.min(axis=0)).argmax())
                order[start:stop] = own[np.argpartition(rows[:, axis], middle)]
            halved += [start + middle, stop]
        cuts = halved
        bounds += zip(cuts, cuts[1:], strict=False)
    points = points[order]
    first = [start for start, _ in bounds[len(bounds) // 2 :]]
    wide = points.astype(object) if n * _largest(points) >= WIDE else points.astype(np.int64)
    # No leaf is empty: a node of more than `leaf` points has at least two.
    low, high, sums = ([f.reduceat(x, first, axis=0)] for f, x in ((np.minimum, points), (np.maximum, points), (np.add, wide)))
    for _ in range(depth):
        for levels, f in ((low, np.minimum), (high, np.maximum), (sums, np.add)):
            levels.append(f(levels[-1][::2], levels[-1][1::2]))
    return order, Tree(points, np.array(bounds), *(np.concatenate(x[::-1]) for x in (low, high, sums)))


def _largest(points: np.ndarray) -> int:
    return max(abs(int(points.max(initial=0))), abs(int(points.min(initial=0))))


class Centroids:
    """Integer centroids in the arithmetic that is exact for distances to points with components up to ``largest``."""

    def __init__(self, rows: list[list[int]], largest: int):
        dims = len(rows[0])
        most = 4 * dims * max(largest, 1) ** 2  # above every squared distance and every term of one
        self.kind = np.float64 if most < EXACT else np.int64 if most < WIDE else object
        self.z = np.array(rows, self.kind).reshape(len(rows), dims)
        self.norms = (self.z * self.z).sum(axis=1)
        self.near = self.z.astype(float)
        self.distinct = np.zeros(len(rows), bool)
        self.distinct[list({tuple(row): i for i, row in reversed(list(enumerate(rows)))}.values())] = True

    def undominated(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Of each box's centroids those that no point of the box is strictly farther from than from the one nearest to its middle."""
        middle = (low.astype(float) + high) / 2
        best = np.where(alive, (self.near * self.near).sum(axis=1) - 2 * middle @ self.near.T, np.inf).argmin(axis=1)
        keep = alive.copy()
        for b in np.unique(best):
            rows = np.flatnonzero(best == b)
            those = np.flatnonzero(alive[rows].any(axis=0))
            apart = self.z[those] - self.z[b]
            # The point of the box that favours the other centroid most is a corner.
            reach = high[rows].astype(self.kind) @ np.maximum(apart, 0).T + low[rows].astype(self.kind) @ np.minimum(apart, 0).T
            keep[np.ix_(rows, those)] &= self.norms[those] - self.norms[b] - 2 * reach <= 0
        return keep

    def resolve(self, points: np.ndarray, those: np.ndarray) -> np.ndarray:
        """The nearest of ``those`` centroids for each point; ties go to the smaller number."""
        return those[(self.norms[those] - 2 * (points.astype(self.kind) @ self.z[those].T)).argmin(axis=1)]

    def distances(self, points: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Squared distances to the owners; beyond a long the largest long."""
        apart = points.astype(self.kind) - self.z[owner]
        return np.minimum((apart * apart).sum(axis=1), MOST if self.kind is object else np.inf if self.kind is np.float64 else MOST).astype(np.int64)

    def filtered(self, tree: Tree) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
        """Whole nodes with their owners, and points of other leaves with theirs."""
        whole, single = [], []
        nodes, alive = np.zeros(1, np.int64), self.distinct[None, :]
        while len(nodes):
            alive = self.undominated(tree.low[nodes], tree.high[nodes], alive)
            one = alive.sum(axis=1) == 1
            whole.append((nodes[one], alive[one].argmax(axis=1)))
            nodes, alive = nodes[~one], alive[~one]
            leaf = nodes >= tree.first_leaf
            if leaf.any():
                kinds, which = np.unique(np.packbits(alive[leaf], axis=1), axis=0, return_inverse=True)
                ends = nodes[leaf]
                for k in range(len(kinds)):
                    own = ends[which.ravel() == k]
                    at = np.concatenate([np.arange(*tree.bounds[x]) for x in own])
                    single.append((at, self.resolve(tree.points[at], np.flatnonzero(np.unpackbits(kinds[k], count=len(self.z))))))
            nodes, alive = nodes[~leaf], alive[~leaf]
            nodes, alive = np.concatenate([2 * nodes + 1, 2 * nodes + 2]), np.concatenate([alive, alive])
        return whole, single


def _planter(leaf: int, rows: int):
    """One row per tree: ids, points, node ranges, boxes and sums, packed."""

    def planted(ids: np.ndarray, points: np.ndarray) -> dict:
        order, tree = build(points, leaf)
        width = 2 if _largest(points) < 1 << 15 else 4 if _largest(points) < 1 << 31 else 8
        small = lambda x: x.astype(f"<i{width}").tobytes()
        sums = tree.sums.astype("<i8").tobytes() if tree.sums.dtype != object else "\n".join(map(str, tree.sums.ravel())).encode()
        return {"ids": ids[order].astype("<i8").tobytes(), "points": small(tree.points), "width": width, "bounds": tree.bounds.astype("<i4").tobytes(), "low": small(tree.low), "high": small(tree.high), "sums": sums}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ids", pa.binary()), ("points", pa.binary()), ("width", pa.int32()), *((c, pa.binary()) for c in ("bounds", "low", "high", "sums"))])
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def gathered() -> pa.RecordBatch:
            ids, points = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            return pa.RecordBatch.from_pylist([planted(ids, points)], schema)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - sum(len(i) for i, _ in waiting))
                at += part.num_rows
                waiting.append((part.column(0).to_numpy(), matrix(part.column(1))))
                if sum(len(i) for i, _ in waiting) == rows:
                    yield gathered()
        if waiting:
            yield gathered()

    return textops.returning(run)


def _read(row: dict, dims: int) -> tuple[np.ndarray, Tree]:
    small = lambda c: np.frombuffer(row[c], f"<i{row['width']}").reshape(-1, dims)
    bounds = np.frombuffer(row["bounds"], "<i4").reshape(-1, 2)
    raw = row["sums"]
    sums = np.frombuffer(raw, "<i8") if len(raw) == 8 * dims * len(bounds) else np.array([int(x) for x in raw.split(b"\n")], object)
    return np.frombuffer(row["ids"], "<i8"), Tree(small("points"), bounds, small("low"), small("high"), sums.reshape(-1, dims))


def _summer(sent, dims: int):
    """Counts (axis -1) and componentwise sums of the task's vectors, by centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        count, total = np.zeros(len(c.z), np.int64), np.zeros((len(c.z), dims), object)
        for batch in batches:
            for row in batch.to_pylist():
                _, tree = _read(row, dims)
                whole, single = c.filtered(tree)
                part = np.zeros((len(c.z), dims), tree.sums.dtype)
                for nodes, owner in whole:
                    np.add.at(part, owner, tree.sums[nodes])
                    np.add.at(count, owner, np.diff(tree.bounds[nodes], axis=1).ravel())
                for at, owner in single:
                    np.add.at(part, owner, tree.points[at].astype(part.dtype))
                    np.add.at(count, owner, 1)
                total += part
        used = np.flatnonzero(count)
        if len(used):
            values = np.column_stack([count[used].astype(object), total[used]]).ravel()
            yield pa.RecordBatch.from_pydict({"cluster": np.repeat(used, dims + 1).astype(np.int32), "axis": np.tile(np.arange(-1, dims), len(used)).astype(np.int32), "value": pa.array([Decimal(int(x)) for x in values], pa.decimal128(38, 0))})

    return textops.returning(run)


def _assigner(sent, dims: int):
    """Owner and squared distance of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, tree = _read(row, dims)
                owners = np.zeros(len(ids), np.int64)
                whole, single = c.filtered(tree)
                for nodes, owner in whole:
                    for x, o in zip(nodes, owner, strict=True):
                        owners[slice(*tree.bounds[x])] = o
                for at, owner in single:
                    owners[at] = owner
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": owners.astype(np.int32), "distance": c.distances(tree.points, owners)})

    return textops.returning(run)


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2") -> DataFrame:
    """Every vector's cluster after ``rounds`` rounds of k-means in integers, and the cluster's figures.

    ``vectors`` holds vec_id (long) and q (long[]), as made by ``quantised``; rows without vec_id or q, or with
    other than ``dims`` components, are left out, further columns ignored. Centroids 0, 1, ... start as the k vectors with the smallest
    sha256 of "<salt>:<vec_id>" (of rows that share a vec_id the lesser q first); with fewer vectors there are as many
    centroids, with none the result is empty. A round assigns each vector to the nearest centroid (squared
    Euclidean distance, ties to the smaller number) and moves each non-empty centroid to its vectors'
    componentwise floor(sum / count). Columns: vec_id, cluster (int), distance (long), cluster_inertia and inertia (long: distance summed over
    the cluster and over all), centroid_sha256. All is exact whatever the components; distances and their sums beyond a long are given as the largest long.
    Repeated rows are rows of their own.

    Each partition's vectors are put into kd-trees of TREE_ROWS at most, once, without a shuffle; a tree's nodes hold ranges, integer sums and
    boxes. In each round centroids pass down from the root: those that another is strictly nearer to in the whole box go, a node with one left is
    assigned whole by its sum, and the points of the remaining leaves are resolved among the leaf's centroids. Tasks send on one
    number per centroid and component; the driver sees k centroids.
    """
    spark = vectors.sparkSession
    own = vectors.select("vec_id", "q").where(F.col("vec_id").isNotNull() & (F.size("q") == dims))
    token = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = [list(r.q) for r in own.orderBy(token, "q").limit(k).collect()]
    trees = cut(own.mapInArrow(_planter(LEAF_ROWS, TREE_ROWS), _TREE))
    if not seeds:
        return own.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256")).where(F.lit(False))
    high, low = own.agg(F.max(F.array_max("q")), F.min(F.array_min("q"))).first()
    largest = max(abs(high), abs(low))
    for _ in range(rounds):
        sums = trees.mapInArrow(_summer(spark.sparkContext.broadcast(Centroids(seeds, largest)), dims), "cluster int, axis int, value decimal(38,0)")
        moved = {(r.cluster, r.axis): int(r.value) for r in sums.groupBy("cluster", "axis").agg(F.sum("value").alias("value")).collect()}  # k x (dims + 1) rows at most
        seeds = [[moved[i, x] // moved[i, -1] for x in range(dims)] if (i, -1) in moved else row for i, row in enumerate(seeds)]
    assigned = cut(trees.mapInArrow(_assigner(spark.sparkContext.broadcast(Centroids(seeds, largest)), dims), "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # k rows at most
    figures = [(i, min(v, MOST), min(sum(inertia.values()), MOST), hashlib.sha256(",".join(map(str, seeds[i])).encode()).hexdigest()) for i, v in inertia.items()]
    told = spark.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
