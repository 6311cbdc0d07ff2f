"""Vectors as blocks of whole numbers.

Every component x becomes floor(1024 * x), so sums, means and squared distances are exact at any size and in any order.
A block is one row with a few thousand vectors; blocks are cut from the partitions that the table is read in, written
once to the shared folder and read anew in each round, so a hot id or label moves nothing and a lost executor costs
the tasks that it had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut

SCALE = 1024
#: Bytes of the numbers of a block.
BLOCK_BYTES = 1 << 20


def usable(vector: Column, dim: int | None = None) -> Column:
    """Not null, of `dim` components (any number but none, if None), and none of them null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.when(F.size(vector) == dim if dim else F.size(vector) > 0, finite), F.lit(False))


def whole(rows: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of doubles, as 64-bit integers.

    An error where a squared distance might not fit 64 bits: components of 2**24 (64 of them), far from any embedding.
    """
    x = np.floor(SCALE * np.asarray(rows, np.float64))
    most = np.abs(x).max(initial=0)
    if most >= 2**31 or (2 * most) ** 2 * x.shape[-1] >= 2.0**62:
        raise ValueError(f"components up to {most / SCALE:g} are too large for exact distances")
    return x.astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances [n, k] of integer rows: by products of doubles where all they hold is below 2**53, else of integers."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    kind = np.float64 if (2 * most) ** 2 * x.shape[1] < 2**52 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)


def sums_by(label: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The labels found, how many rows each has, and the rows' sums."""
    order = np.argsort(label, kind="stable")
    found, at = np.unique(label[order], return_index=True)
    return found, np.diff(np.append(at, len(label))), np.add.reduceat(x[order], at, axis=0) if len(at) else x[:0]


class Vectors:
    """ids and whatever else goes with a block's vectors (Arrow arrays), x [n, dim], and the arrays that `prepare` has added."""

    def __init__(self, batch: pa.RecordBatch, row: int, carry: tuple[str, ...], dim: int):
        self.with_ = {c: col(batch, c)[row].values for c in carry}
        self.x = np.frombuffer(col(batch, "x")[row].as_py(), np.int32).reshape(-1, dim).astype(np.int64)
        self.extra = col(batch, "extra")[row].as_py()


def vector_blocks(rows: DataFrame, dim: int, carry: dict[str, str], vector: str, prepare: Callable[[np.ndarray], tuple[np.ndarray, bytes]] | None = None) -> DataFrame:
    """Blocks of the rows, which hold usable vectors of `dim` components: the carried columns (name, type) as arrays, x, extra.

    prepare(x) gives the order in which the block keeps its vectors, and bytes to keep with them.
    """
    size = max(1, BLOCK_BYTES // (4 * dim))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                flat = col(part, "_v")
                x = whole(flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                order, extra = prepare(x) if prepare else (np.arange(len(x)), b"")
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), col(part, f"_{c}_").take(pa.array(order))) for c in carry]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([x[order].astype(np.int32).tobytes()]), pa.array([extra], pa.binary())], [*carry, "x", "extra"])

    picked = rows.select(F.col(vector).cast("array<double>").alias("_v"), *(F.col(c).cast(kind).alias(f"_{c}_") for c, kind in carry.items()))
    return cut(picked.mapInArrow(work, ", ".join([*(f"{c} array<{kind}>" for c, kind in carry.items()), "x binary", "extra binary"])), "vectors")


def each_vectors(batches: Iterator[pa.RecordBatch], carry: tuple[str, ...], dim: int) -> Iterator[Vectors]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Vectors(batch, row, carry, dim)


def totals(partial: DataFrame, keys: tuple[str, ...], dim: int) -> dict[tuple, tuple[int, np.ndarray]]:
    """Rows of (keys, n, sums) added up by Spark: {keys: (n, sums)}; what comes to the driver is as large as the centres."""
    flat = partial.select(*keys, "n", F.posexplode("sums").alias("at", "x"))
    out: dict[tuple, tuple[int, np.ndarray]] = {}
    for r in flat.groupBy(*keys, "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        out.setdefault(tuple(r[k] for k in keys), (r["n"], np.zeros(dim, np.int64)))[1][r["at"]] = r["x"]
    return out
