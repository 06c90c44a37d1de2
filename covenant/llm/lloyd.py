"""Centroid clustering: Lloyd's method by dual trees.

Vectors are read once and put into cover trees, one for each BLOCK_ROWS vectors of a
task, which are written to the shared folder. Every round builds a tree over the
centroids, and every task walks down its trees and that one together: a pair of nodes is
left out when the distance of their centres, less both radii, is above what some
centroid is at most away from all vectors of the node. Where one centroid is left,
it takes a whole subtree, whose sum is known without looking at its vectors; at leaves
vectors and the centroids that are left are compared exactly, in integers. Tasks pass
on one sum for each centroid and component, so a round shuffles little and the driver
gets no more than the centroids.

A cover tree's node is a vector with a radius; its children are vectors at most a
smaller radius, a power of BASE, away from what they cover, and further than that apart.
A node is a leaf if it has at most LEAF_ROWS vectors, or if so many children would be
needed that they hold fewer than LEAST_CHILD vectors on average: then distances are so
even that no bound tells vectors apart, and the leaf's vectors are compared at once.

Only vectors of exactly `size` components take part, none null or non-finite; each is
floor(scale * x) as an integer. Equal distances go to the centroid of smaller number.
The first centroids are the k vectors with the smallest SHA-256 of "3:" and their id
(nothing for a null id); equal ones are ordered by vector. Repeated rows are vectors of
their own. With fewer than k vectors there are as many centroids; without any, the
result is empty. Centroids that lose all vectors stay. Only id and vector are read, so
other columns may have any names. A component beyond LARGEST after scaling is an error,
as distances would not be integers of 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

SIZE = 64
SCALE = 1024
BLOCK_ROWS = 2_048
LEAF_ROWS = 32
LEAST_CHILD = 4
#: Radii of a tree's levels are powers of this.
BASE = 1.3
LARGEST = 1 << 26
SALT = "3:"
BLOCKS = "ids array<bigint>, data binary, nodes binary, radii binary"


@dataclass
class Tree:
    """Nodes in preorder. A node's vectors stand from first to last in the tree's order, its centre is one of them; next is the node after its subtree."""

    centre: np.ndarray
    first: np.ndarray
    last: np.ndarray
    next: np.ndarray
    radius: np.ndarray

    def children(self, node: int) -> list[int]:
        out, at = [], node + 1
        while at < self.next[node]:
            out.append(at)
            at = int(self.next[at])
        return out

    def is_leaf(self, node: int) -> bool:
        return self.next[node] == node + 1


def slack(points: np.ndarray) -> float:
    """What a distance of doubles may be off, at most, for vectors like these."""
    return 1e-6 * (1.0 + float(np.abs(points).max(initial=0)) * math.sqrt(points.shape[1]))


def cover_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS, least_child: int = LEAST_CHILD) -> tuple[Tree, np.ndarray]:
    """A cover tree over the rows of points, and their order in it. Top down: a node's children are a greedy net of its vectors."""
    x = points.astype(np.float64)
    squares = (x * x).sum(axis=1)
    off = slack(points)

    def away(centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, squares[rows] + squares[centre] - 2 * (x[rows] @ x[centre]))) + off

    def net(centre: int, rows: np.ndarray, far: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
        within, most = BASE ** (math.ceil(math.log(radius, BASE)) - 1), len(rows) // least_child if least_child else len(rows)
        out: list[tuple[int, np.ndarray]] = []
        while len(rows):
            if len(out) == most:
                return []
            near = far <= within
            near[rows == centre] = True
            out.append((centre, rows[near]))
            rows = rows[~near]
            if len(rows):
                centre = int(rows[0])
                far = away(centre, rows)
        return out

    nodes: list[list] = []
    order: list[np.ndarray] = []
    done = 0
    stack: list[tuple] = [(0, np.arange(len(x)))] if len(x) else []
    while stack:
        centre, rows = stack.pop()
        if rows is None:  # the subtree of this node is whole
            nodes[centre][2:4] = done, len(nodes)
            continue
        far = away(centre, rows)
        radius = float(far.max())
        nodes.append([centre, done, 0, 0, radius])
        children = net(centre, rows, far, radius) if len(rows) > leaf_rows and radius > 4 * off else []
        if len(children) > 1:
            stack.append((len(nodes) - 1, None))
            stack.extend(reversed(children))
        else:
            order.append(rows)
            done += len(rows)
            nodes[-1][2:4] = done, len(nodes)
    ordered = np.concatenate(order) if order else np.empty(0, np.int64)
    place = np.empty(len(x), np.int64)
    place[ordered] = np.arange(len(x))
    table = np.array(nodes, np.float64).reshape(-1, 5)
    centre, first, last, after = table[:, :4].astype(np.int64).T
    return Tree(place[centre], first, last, after, table[:, 4]), ordered


def assign(tree: Tree, points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Nearest centroid of each of a tree's points; subtrees that one centroid takes whole (first, last, centroid); what was looked at."""
    goal, numbers = cover_tree(centroids, 1, 0)
    x, c = points.astype(np.float64), centroids[numbers].astype(np.float64)
    off = 2 * max(slack(points), slack(centroids))
    labels = np.empty(len(points), np.int64)
    subtrees: list[tuple[int, int, int]] = []
    counts = {"pairs": 0, "compared": 0}
    stack = [(0, [0])] if len(tree.centre) else []
    while stack:
        node, pairs = stack.pop()
        radius, centre, leaf = tree.radius[node], x[tree.centre[node]], tree.is_leaf(node)
        while True:
            counts["pairs"] += len(pairs)
            at = np.sqrt(((c[goal.centre[pairs]] - centre) ** 2).sum(axis=1))
            # each node's centre is a centroid, and no vector here is further away from the nearest of these
            most = at.min() + radius + off
            left = [p for p, d in zip(pairs, at, strict=True) if d - radius - goal.radius[p] <= most]
            # a leaf meets single centroids; an inner node splits the side that is larger
            split = {p for p in left if not goal.is_leaf(p) and (leaf or goal.radius[p] >= radius)}
            if not split:
                break
            pairs = [k for p in left for k in (goal.children(p) if p in split else [p])]
        first, last = int(tree.first[node]), int(tree.last[node])
        ks = np.sort(np.concatenate([numbers[goal.first[p] : goal.last[p]] for p in left]))
        if len(ks) == 1:
            labels[first:last] = ks[0]
            subtrees.append((first, last, int(ks[0])))
        elif leaf:
            labels[first:last] = ks[distances(points[first:last], centroids[ks]).argmin(axis=1)]
            counts["compared"] += (last - first) * len(ks)
        else:
            stack.extend((k, left) for k in tree.children(node))
    return labels, np.array(subtrees, np.int64).reshape(-1, 3), counts


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances as exact integers."""
    out = np.empty((len(points), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        past = points - c
        out[:, k] = np.einsum("ij,ij->i", past, past)
    return out


def whole(vector: Column, size: int, scale: int) -> Column:
    """The vector's components as integers; null if it takes no part."""
    x = vector.cast("array<double>")
    fit = (F.size(x) == size) & F.forall(x, lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")), F.lit(False)))
    scaled = F.transform(x, lambda v: F.floor(v * scale))
    bound = F.forall(scaled, lambda v: F.abs(v) < LARGEST)
    return F.when(F.coalesce(fit, F.lit(False)), F.when(bound, scaled).otherwise(F.raise_error(F.lit(f"components beyond {LARGEST} after scaling"))))


def trees(vectors: DataFrame, size: int) -> DataFrame:
    """Cover trees over the rows (id, x) as they are read, BLOCK_ROWS vectors each: ids and vectors in the tree's order, and its nodes."""

    def grown(ids: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        points = np.concatenate(rows).reshape(-1, size)
        tree, order = cover_tree(points)
        nodes = np.stack([tree.centre, tree.first, tree.last, tree.next]).astype(np.int32)
        row = ([ids[k] for k in order], points[order].astype(np.int32).tobytes(), nodes.tobytes(), tree.radius.tobytes())
        kinds = (pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["ids", "data", "nodes", "radii"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids += part["id"].to_pylist()
                rows.append(part["x"].flatten().to_numpy(zero_copy_only=False))
                n += part.num_rows
                if n >= BLOCK_ROWS:
                    yield grown(ids, rows)
                    ids, rows, n = [], [], 0
        if n:
            yield grown(ids, rows)

    return vectors.select("id", "x").mapInArrow(run, BLOCKS)


def _read(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, np.ndarray, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, data, nodes, radii = (batch[c][k].as_py() for c in ("ids", "data", "nodes", "radii"))
            points = np.frombuffer(data, np.int32).reshape(-1, size).astype(np.int64)
            yield ids, points, Tree(*np.frombuffer(nodes, np.int32).reshape(4, -1).astype(np.int64), np.frombuffer(radii))


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the mean of each one's vectors."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), size + 1), np.int64)
        for _, points, tree in _read(batches, size):
            labels, subtrees, _ = assign(tree, points, centroids)
            sums = np.concatenate([np.zeros((1, size), np.int64), np.cumsum(points, axis=0)])
            single = np.ones(len(points), bool)
            for first, last, k in subtrees:
                total[k, :size] += sums[last] - sums[first]
                total[k, size] += last - first
                single[first:last] = False
            for k in np.unique(labels[single]):
                own = points[single & (labels == k)]
                total[k, :size] += own.sum(axis=0)
                total[k, size] += len(own)
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k, at])], names=["k", "at", "n"])

    total = np.zeros((len(centroids), size + 1), np.int64)
    for r in blocks.mapInArrow(run, "k int, at int, n bigint").groupBy("k", "at").agg(F.sum("n").alias("n")).collect():
        total[r.k, r.at] = r.n
    some = total[:, size] > 0
    out = centroids.copy()
    out[some] = total[some, :size] // total[some, size:]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, tree in _read(batches, size):
            labels, _, _ = assign(tree, points, centroids)
            past = points - centroids[labels]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels.astype(np.int32)), pa.array(np.einsum("ij,ij->i", past, past))], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def first_centroids(vectors: DataFrame, k: int) -> list[list[int]]:
    key = F.sha2(F.concat(F.lit(SALT), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [r.x for r in vectors.select(key.alias("key"), "id", "x").orderBy("key", F.asc_nulls_first("id"), "x").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector (id, vector) that takes part."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col("id").cast("bigint").alias("id"), whole(F.col("vector"), size, scale).alias("x")).where("x is not null")
    centroids = np.array(first_centroids(kept, k), np.int64).reshape(-1, size)
    blocks = written(trees(kept, size), "trees")
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(blocks, centroids)
    found = written(assigned(blocks, centroids), "clusters")
    sums = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    facts = [(j, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids) if j in sums]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
