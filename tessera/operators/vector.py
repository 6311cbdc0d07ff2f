"""Exact nearest neighbours by cosine, in blocks, and an inverted-file index as the approximate form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Components of the query vectors that one pass takes to the workers (32 MB); more queries make more passes.
PASS = 1 << 22
SMALL = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where lengths differ or a norm vanishes."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms < SMALL), F.lit(1.0)).otherwise(1 - dot(a, b) / norms)


def similarity(a: Column, b: Column) -> Column:
    return 1 - cosine_distance(a, b)


def check_vectors(vectors: DataFrame, dim: int | None = None, vector: str = "vector") -> int:
    """The dimension that all vectors share; an error for none, empty or different ones, or one unlike `dim`."""
    lo, hi = vectors.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if lo is None or lo <= 0:
        raise ValueError("no vectors, or an empty one")
    if lo != hi:
        raise ValueError(f"vectors have {lo} to {hi} dimensions")
    if dim not in (None, lo):
        raise ValueError(f"vectors have {lo} dimensions, the store has {dim}")
    return lo


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """[n, dim] of the rows with that length, and which rows those are."""
    column = column.cast(pa.list_(pa.float64()))
    size = np.diff(column.offsets.to_numpy())
    ok = (size == dim) & ~np.asarray(column.is_null())
    if ok.all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), ok
    rows = [x.as_py() for x, k in zip(column, ok, strict=True) if k]
    return np.array(rows, np.float64).reshape(-1, dim), ok


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)
    return np.where(norms < SMALL, 0.0, (x @ q.T) / np.maximum(norms, SMALL))


def passes(queries: DataFrame, query_id: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    ids, rows = [], []
    for row in queries.select(query_id, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        ids.append(row[0]), rows.append(np.array(row[1], np.float64))
        if len(ids) * max(1, len(rows[0])) >= PASS:
            yield ids, np.array(rows)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows)


#: Chunks that one task compares at least, and the rows and queries of a tile, whose cosines it holds at once (4 MB).
TASK, ROWS, ASKED = 1 << 14, 1024, 512


def k_best(query: np.ndarray, key: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k best of their query, ties by key."""
    order = np.lexsort((key, -cos, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[place < k]


def knn(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "vector", digits: int = 6, rows: int | None = None) -> DataFrame:
    """query_id, chunk_id, cos (rounded), rank: the k nearest chunks of every query, ties by chunk id.

    A task multiplies its chunks with all queries of a pass, a tile at a time, and keeps its own k best, so at most
    k rows a task and query are shuffled to the final ranking, and a task holds a tile and those rows, however many
    chunks there are.  `rows`, how many chunks there are, is for chunks that are written already; others are written
    here, once for all passes.  Tasks have at least TASK chunks.  A vector of another length, or a null one, has
    cosine 0.
    """
    sc, out = queries.sparkSession.sparkContext, None
    kinds = [queries.schema[query_id].dataType.simpleString(), chunks.schema[chunk_id].dataType.simpleString()]
    picked = chunks.select(F.col(chunk_id).alias("_c"), F.col(vector).alias("_v"))
    if rows is None:
        picked = cut(picked, "vectors")
        rows = picked.count()
    picked = picked.coalesce(max(1, -(-rows // TASK)))
    for ids, q in passes(queries, query_id, vector):
        shared = sc.broadcast((ids, q))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            held = [(np.zeros(0, int), None, np.zeros(0)) for _ in range(0, len(q), ASKED)]  # query, key, cosine: the best of each tile's queries
            least = np.full(len(q), -2.0)  # the last of the k best, where there are k
            kind = None
            for batch in batches:
                kind = batch.schema.field(0).type
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    x, ok = matrix(part.column(1), q.shape[1])
                    keys = np.asarray(part.column(0))
                    whole = np.zeros((len(ok), q.shape[1]))
                    whole[ok] = x
                    for at in range(0, len(q), ASKED):
                        near = least[at : at + ASKED]
                        cos = cosines(whole, q[at : at + ASKED])
                        np.round(cos, digits, out=cos)
                        cos += 0.0
                        if len(cos) > k:  # no more than the k best of each query, and what ties with the last
                            np.maximum(near, np.partition(cos, len(cos) - k, axis=0)[len(cos) - k], out=near)
                        row, query = np.nonzero(cos >= near)
                        if not len(row):
                            continue
                        old = held[at // ASKED]
                        new = np.concatenate([old[0], query]), keys[row] if old[1] is None else np.concatenate([old[1], keys[row]]), np.concatenate([old[2], cos[row, query]])
                        best = k_best(*new, k)
                        new = held[at // ASKED] = tuple(v[best] for v in new)
                        last = np.arange(len(best))[np.append(new[0][1:] != new[0][:-1], True)]  # in order of queries, the best first
                        full = last[np.bincount(new[0], minlength=len(near))[new[0][last]] == k]
                        near[new[0][full]] = new[2][full]
            for at, (query, keys, cos) in enumerate(held):
                if keys is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([names[at * ASKED + j] for j in query]), pa.array(keys, kind), pa.array(cos)], ["q", "c", "cos"])

        part = picked.mapInArrow(work, f"q {kinds[0]}, c {kinds[1]}, cos double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = queries.sparkSession.createDataFrame([], f"q {kinds[0]}, c {kinds[1]}, cos double")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "c")).cast("long")).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("c").alias(chunk_id), "cos", "rank")


#: Components of a block of similar_pairs(), and sampled centres that blocks are made around.
BLOCK, CENTRES = 1 << 19, 4096


def blocks_of(vectors: DataFrame, key: str, vector: str, dim: int) -> tuple[DataFrame, int]:
    """(block, keys, x, centre, radius) for blocks of vectors near to each other, numbered from 0, and how many.

    radius is the greatest angle between the block's centre and one of its vectors.  A cell around a sampled centre that
    is too large for a block, or a vector that many rows share, is cut up by a hash of the key.
    """
    rows = vectors.where(F.size(vector) == dim).select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
    n, most = rows.count(), max(1, BLOCK // dim)
    sample = rows.orderBy(F.xxhash64("_k"), "_k").limit(min(CENTRES, -(-n // most))).select("_v").collect()
    centres = np.array([r[0] for r in sample], np.float64).reshape(-1, dim)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), SMALL)

    def place(batches: Iterator[pa.RecordBatch], first: np.ndarray | None = None, parts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) @ centres.T).argmax(1)
            if first is not None:
                cell = first[cell] + (np.asarray(batch.column(2)).view(np.uint64) >> np.uint64(11)).astype(np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), *batch.columns[:2]], ["block", "_k", "_v"])

    kind = vectors.schema[key].dataType.simpleString()
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(1), "_k"))
    schema = f"block bigint, _k {kind}, _v array<double>"
    parts = np.zeros(len(centres), np.int64)
    for r in hashed.mapInArrow(place, schema).groupBy("block").count().collect():  # one row a centre
        parts[r["block"]] = -(-r["count"] // most)
    first = np.cumsum(parts) - parts

    def pack(block: pa.Table) -> pa.Table:
        x = block.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        unit = x / np.maximum(norm, SMALL)
        centre = unit.sum(0)
        centre /= max(np.linalg.norm(centre), SMALL)
        radius = np.arccos(np.clip(unit @ centre, -1, 1)).max() if (norm >= SMALL).all() else np.pi  # a zero vector has no direction
        keys = block.column("_k").combine_chunks()
        lists_ = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.Table.from_arrays([block.column("block").slice(0, 1).combine_chunks(), lists_, pa.array([x.tobytes()]), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(radius)])], ["block", "keys", "x", "centre", "radius"])

    dealt = hashed.mapInArrow(lambda batches: place(batches, first, np.maximum(parts, 1)), schema)
    return cut(dealt.groupBy("block").applyInArrow(pack, f"block bigint, keys array<{kind}>, x binary, centre array<double>, radius double"), "blocks"), int(parts.sum())


def similar_pairs(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """a, b (a < b), cos: pairs with cosine above `least`, compared exactly, block against block, each pair of blocks once.

    A pair of blocks is left out where the angle between their centres, less both radii, is above the angle of `least`.
    Null vectors, null keys and vectors of another than the commonest length are in no pair; a zero vector's cosine is 0.
    """
    kind = vectors.schema[key].dataType.simpleString()
    good = vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0))
    sizes = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}, cos double")
    dim = sizes["d"]
    blocks, count = blocks_of(good, key, vector, dim)
    about = blocks.select("block", "centre", "radius")
    other = about.select(F.col("block").alias("with"), F.col("centre").alias("centre_"), F.col("radius").alias("radius_"))
    pairs = about.select("block", "centre", "radius", F.explode(F.sequence("block", F.lit(count - 1).cast("long"))).alias("with")).join(other, "with")
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("centre"), F.col("centre_")))))
    near = pairs.where(between - F.col("radius") - F.col("radius_") <= float(np.arccos(np.clip(least, -1, 1))) + 1e-6) if least > 0 else pairs
    left = blocks.select("block", F.col("keys").alias("ka"), F.col("x").alias("xa"))
    right = blocks.select(F.col("block").alias("with"), F.col("keys").alias("kb"), F.col("x").alias("xb"))
    both = near.select("block", "with").join(left, "block").join(right, "with")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, with_ = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                ka, kb = (np.asarray(batch.column(i)[row].values) for i in (2, 4))
                xa, xb = (np.frombuffer(batch.column(i)[row].as_py(), np.float64).reshape(-1, dim) for i in (3, 5))
                for lo in range(0, len(xa), 512):
                    cos = np.round(cosines(xa[lo : lo + 512], xb), digits)
                    i, j = np.nonzero(cos > least)
                    a, b, c = ka[lo + i], kb[j], cos[i, j]
                    up = a < b
                    down = (a > b) & (block != with_)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[up], b[down]])), pa.array(np.concatenate([b[up], a[down]])), pa.array(np.concatenate([c[up], c[down]]))], ["a", "b", "cos"])

    # a few rows of some MB each: a task for each pair of blocks, up to Spark's own number of them
    return both.select("block", "with", "ka", "xa", "kb", "xb").mapInArrow(work, f"a {kind}, b {kind}, cos double")


# --- the approximate index -----------------------------------------------------------------


class InvertedFile:
    """Cells around centres; a query looks into its nearest `probes` cells.

    The centres are fitted on at most `sample` vectors; every vector is indexed.  Recall against knn() is
    part of the tests.
    """

    def __init__(self, chunks: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 10, chunk_id: str = "chunk_id", vector: str = "vector"):
        self.chunk_id, self.vector = chunk_id, vector
        rows = chunks.select(vector).where(F.col(vector).isNotNull()).orderBy(F.xxhash64(chunk_id)).limit(sample).toArrow()
        x = self._unit(matrix(rows.column(0).combine_chunks(), len(rows.column(0)[0].as_py()))[0])
        centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
        for _ in range(rounds):
            cell = (x @ centres.T).argmax(1)
            for j in range(len(centres)):
                if (cell == j).any():
                    centres[j] = x[cell == j].sum(0)
            centres = self._unit(centres)
        self.centres = centres
        self.table = self._assigned(chunks, 1)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), SMALL)

    def _assigned(self, rows: DataFrame, n: int) -> DataFrame:
        centres, vector = rows.sparkSession.sparkContext.broadcast(self.centres), self.vector

        @F.pandas_udf("array<int>")
        def near(column):
            import pandas as pd

            x = np.stack(column.to_numpy()).astype(np.float64)
            return pd.Series(list(np.argsort(-(x @ centres.value.T), axis=1)[:, :n].astype(np.int32)))

        return rows.withColumn("cell", F.explode(near(F.col(vector))))

    def search(self, queries: DataFrame, k: int, probes: int = 16, query_id: str = "query_id", digits: int = 6) -> DataFrame:
        """query_id, chunk_id, cos, rank; the join on the cell is Spark's (skewed cells are split)."""
        q = self._assigned(queries, probes).select(query_id, "cell", F.col(self.vector).alias("_q"))
        found = self.table.select(self.chunk_id, "cell", F.col(self.vector).alias("_v")).join(q, "cell")
        scored = found.select(query_id, self.chunk_id, F.round(similarity(F.col("_q"), F.col("_v")), digits).alias("cos"))
        order = Window.partitionBy(query_id).orderBy(F.desc("cos"), self.chunk_id)
        return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
