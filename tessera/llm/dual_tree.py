"""Lloyd's k-means on two trees.

Each block of vectors has a cover tree, built once: a node is a centre, one of its vectors, and the greatest distance
from it to any vector of the node; a node's children are centres of a net with half that radius, so every vector is
within it of a child's centre, and children's centres are further apart.  In each round a tree is built over the
centroids in the same way.  Pairs of a node of either tree are walked together from the roots: a pair goes when its
lower distance bound is above the least upper bound that another pair gives its node of vectors.  A node with one
centroid left is assigned as a whole, without a look at its vectors; leaves that keep several are compared exactly.

Bounds are square roots of exact integers with room for rounding, so nothing that could win or tie is pruned.
Sums and counts are added up by Spark; the driver holds k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release
from .int_vectors import each_vectors, squared, sums_by, totals, usable, vector_blocks, whole

#: A node of vectors isn't cut up below so many.
LEAF = 32
#: Relative room in a bound for the rounding of roots and their sums.
ROOM = 1e-9


class Tree:
    """A cover tree over rows of x, which are reordered by `order` so that a node's rows are lo..hi.

    nodes: one row each of centre (row after reordering), lo, hi, first child, number of children; radius aside.
    """

    def __init__(self, order: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.order, self.radius = order, radius
        self.centre, self.lo, self.hi, self.first, self.children = nodes.T
        self.nodes = nodes

    @classmethod
    def over(cls, x: np.ndarray, leaf: int) -> Tree:
        order = np.arange(len(x))
        nodes, radius, waiting = [[0, 0, len(x), 0, 0]], [0.0], [0]
        for k in waiting:  # grows as nodes are cut up
            _, lo, hi, _, _ = nodes[k]
            rows = order[lo:hi]
            away = np.sqrt(squared(x[rows], x[rows[:1]])[:, 0]) if hi > lo else np.zeros(0)
            radius[k] = away.max(initial=0.0)
            if hi - lo <= leaf or radius[k] == 0:
                continue
            groups = cls._net(x, rows, away, radius[k] / 2, max(leaf, len(rows) // 4) if leaf > 1 else len(rows))
            if groups is None:
                continue
            nodes[k][3:] = len(nodes), len(groups)
            for group in groups:
                order[lo : lo + len(group)] = group
                waiting.append(len(nodes))
                nodes.append([lo, lo, lo + len(group), 0, 0])
                radius.append(0.0)
                lo += len(group)
        return cls(order, np.array(nodes, np.int64), np.array(radius))

    @staticmethod
    def _net(x: np.ndarray, rows: np.ndarray, away: np.ndarray, scale: float, most: int) -> list[np.ndarray] | None:
        """Rows by the first centre of the net within `scale`; None where `most` centres don't cover them, so far apart that a net wouldn't help."""
        groups, left, near = [], rows, away <= scale
        while True:
            groups.append(left[near])
            left = left[~near]
            if not len(left):
                return groups
            if len(groups) >= most:
                return None
            near = squared(x[left], x[left[:1]])[:, 0] <= scale * scale

    def pack(self) -> bytes:
        return len(self.nodes).to_bytes(8, "little") + self.nodes.tobytes() + self.radius.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        n = int.from_bytes(data[:8], "little")
        return cls(np.zeros(0, np.int64), np.frombuffer(data, np.int64, n * 5, 8).reshape(-1, 5), np.frombuffer(data, np.float64, n, 8 + n * 40))


def expand(which: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `which`, count rows: which one, and first, first + 1, ..."""
    at = np.repeat(which, count)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def assign(vectors: Tree, x: np.ndarray, centres: Tree, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each vector's nearest centroid (the least of equals), and how many distances were computed.

    x and c are in their trees' orders; the numbers are those of c before it was reordered.
    """
    out, done = np.full(len(x), -1, np.int64), 0
    v = u = np.zeros(int(len(x) > 0), np.int64)
    while len(v):
        done += len(v)
        distance = np.sqrt(((x[vectors.centre[v]] - c[centres.centre[u]]) ** 2).sum(1))
        rv, ru = vectors.radius[v], centres.radius[u]
        best = np.full(len(vectors.nodes), np.inf)
        np.minimum.at(best, v, distance + rv)  # a centre of the centroids' tree is a centroid
        keep = distance - rv - ru <= best[v] + ROOM * (distance + rv + ru) + ROOM
        v, u = v[keep], u[keep]
        alone = np.bincount(v, centres.hi[u] - centres.lo[u], len(vectors.nodes))[v] == 1
        for node, centre in zip(v[alone], u[alone], strict=True):
            out[vectors.lo[node] : vectors.hi[node]] = centres.order[centres.lo[centre]]
        v, u = v[~alone], u[~alone]
        # of a node's pairs, either the node of vectors is cut up, or the nodes of centroids are
        inner = np.bincount(v, centres.children[u] > 0, len(vectors.nodes)) > 0
        wide = np.zeros(len(vectors.nodes))
        np.maximum.at(wide, v, centres.radius[u])
        leaf = vectors.children == 0
        by_centres = inner & (leaf | (wide > vectors.radius))
        exact = leaf & ~inner
        now = exact[v]
        ends = np.flatnonzero(np.diff(v[now][np.argsort(v[now], kind="stable")], append=-1)) + 1
        begin, nodes, kin = 0, np.sort(v[now], kind="stable"), u[now][np.argsort(v[now], kind="stable")]
        for end in ends:
            node = nodes[begin]
            rows = slice(vectors.lo[node], vectors.hi[node])
            some = np.concatenate([np.arange(centres.lo[k], centres.hi[k]) for k in kin[begin:end]])
            some = some[np.argsort(centres.order[some])]
            at = x[rows] if vectors.radius[node] else x[rows][:1]  # equal vectors are compared once
            done += len(at) * len(some)
            out[rows] = centres.order[some[squared(at, c[some]).argmin(1)]]
            begin = end
        v, u = v[~now], u[~now]
        mine = by_centres[v] & (centres.children[u] > 0)
        cut_v = ~by_centres[v]
        v1, u1 = expand(v[mine], centres.first[u[mine]], centres.children[u[mine]])
        u2, v2 = expand(u[cut_v], vectors.first[v[cut_v]], vectors.children[v[cut_v]])
        rest = by_centres[v] & ~mine
        v, u = np.concatenate([v1, v2, v[rest]]), np.concatenate([u1, u2, u[rest]])
    return out, done


def start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:id`; rows that share an id, by their components; rows without one, last."""
    hashed = vectors.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256))
    return whole(np.array([list(r[0]) for r in hashed.orderBy(F.asc_nulls_last("_h"), "_v").limit(k).select("_v").collect()], np.float64))


def lloyd(rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: k-means by whole numbers.

    Rows whose vector is null, of another length, or holds null or non-finite components are left out.  A row without an
    id is assigned as any other; repeated rows count as often as they stand.  Fewer than k vectors make as many
    centroids; none make no rows.  Ties go to the smaller number.
    """
    return clusters(*fit(rows, k, rounds, seed, dim, key, vector))


def fit(rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray, list[int]]:
    """The blocks with their trees, the centroids after all rounds, and how many distances each round computed."""
    good = rows.where(usable(F.col(vector), dim)).select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    centroids, done = start(good, k, seed), []

    def prepare(x: np.ndarray) -> tuple[np.ndarray, bytes]:
        tree = Tree.over(x, LEAF)
        return tree.order, tree.pack()

    blocks = vector_blocks(good, dim, {"_id": "bigint"}, "_v", prepare)
    for _ in range(rounds if len(centroids) else 0):
        tree = Tree.over(centroids, 1)

        def work(batches: Iterator[pa.RecordBatch], tree=tree, c=centroids[tree.order]) -> Iterator[pa.RecordBatch]:
            number, sums, computed = np.zeros(len(c), np.int64), np.zeros((len(c), dim), np.int64), 0
            for block in each_vectors(batches, (), dim):
                label, n = assign(Tree.unpack(block.extra), block.x, tree, c)
                found, counts, added = sums_by(label, block.x)
                number[found] += counts
                sums[found] += added
                computed += n
            used = np.flatnonzero(number)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(number[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([computed]), pa.array([np.zeros(dim, np.int64)], pa.list_(pa.int64()))], ["cluster", "n", "sums"])

        centroids = centroids.copy()
        for (cluster,), (n, total) in totals(blocks.mapInArrow(work, "cluster int, n bigint, sums array<bigint>"), ("cluster",), dim).items():
            if cluster < 0:
                done.append(n)
            else:
                centroids[cluster] = total // n
    return blocks, centroids, done


def clusters(blocks: DataFrame, centroids: np.ndarray, _done: list[int]) -> DataFrame:
    """The result rows of fitted blocks."""
    spark, dim = blocks.sparkSession, centroids.shape[-1]
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    tree = Tree.over(centroids, 1)

    def work(batches: Iterator[pa.RecordBatch], tree=tree, c=centroids[tree.order]) -> Iterator[pa.RecordBatch]:
        for block in each_vectors(batches, ("_id",), dim):
            label, _ = assign(Tree.unpack(block.extra), block.x, tree, c)
            distance = ((block.x - centroids[label]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([block.with_["_id"], pa.array(label, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = cut(blocks.mapInArrow(work, "vec_id bigint, cluster int, distance bigint"), "clusters")
    release(blocks)
    inertia = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    said = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    per = spark.createDataFrame(said, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast
