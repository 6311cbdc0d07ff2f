"""Product quantisation with nearest entries found in an annulus.

A codebook's entries are sorted by norm.  An entry whose norm differs from a part's by more than the best distance so
far can't be nearer (the triangle inequality), so the part's best is first sought among a few entries of about its
norm; binary search then gives the interval of norms that this distance allows, both ends included, and only entries in
it are compared, exactly.  Parts are taken in order of their norms, a few dozen at a time, whose intervals overlap most;
the interval of such a run is the union of its parts'.  All numbers are whole, so results don't depend on how the work
is split.
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

#: Parts that share an interval, and entries, those of the nearest norms, that the first bound is taken from.
RUN, FIRST = 64, 32


class Codebook:
    def __init__(self, entries: np.ndarray):
        norm = np.sqrt((entries * entries).sum(1))
        self.order = np.argsort(norm, kind="stable")
        self.entries, self.norm = entries[self.order], norm[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number of each row's nearest entry (the least of equals), the squared distance, and how many distances were computed."""
        code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        norm = np.sqrt((x * x).sum(1))
        by_norm, done = np.argsort(norm, kind="stable"), 0
        for lo in range(0, len(x), RUN):
            rows = by_norm[lo : lo + RUN]
            near = max(0, int(np.searchsorted(self.norm, norm[rows[len(rows) // 2]])) - FIRST // 2)
            near = slice(min(near, max(0, len(self.norm) - FIRST)), near + FIRST)
            best = np.sqrt(squared(x[rows], self.entries[near]).min(1))
            room = 1e-9 * (1 + best + norm[rows])  # roots are rounded; the annulus only gets wider
            begin = np.searchsorted(self.norm, norm[rows] - best - room, "left").min()
            end = np.searchsorted(self.norm, norm[rows] + best + room, "right").max()
            number = self.order[begin:end]
            by_number = np.argsort(number)
            distance = squared(x[rows], self.entries[begin:end][by_number])
            pick = distance.argmin(1)
            code[rows], error[rows] = number[by_number][pick], distance[np.arange(len(rows)), pick]
            done += len(rows) * (len(self.norm[near]) + int(end - begin))
        return code, error, done


def start(good: DataFrame, parts: int, entries: int) -> tuple[int, np.ndarray]:
    """The dimension, and [parts, entries, dimension / parts]: the parts of the vectors with the smallest ids, ascending."""
    found = [list(r[0]) for r in good.orderBy(F.asc_nulls_last("_id"), "_v").limit(entries).select("_v").collect()]
    dim = len(found[0]) if found else 0
    if not dim:
        return 0, np.zeros((parts, 0, 0), np.int64)
    first = whole(np.array([x for x in found if len(x) == dim], np.float64))
    return dim, first.reshape(len(first), parts, -1).transpose(1, 0, 2)


def fit(rows: DataFrame, entries: int = 256, rounds: int = 4, parts: int = 4, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray, list[int]]:
    """The blocks, the codebooks after all rounds, and how many distances each round computed."""
    good = rows.where(usable(F.col(vector)) & (F.size(vector) % parts == 0)).select(F.col(key).cast("long").alias("_id"), F.col(label).cast("long").alias("_label"), F.col(vector).cast("array<double>").alias("_v"))
    dim, books = start(good, parts, entries)
    blocks, done = vector_blocks(good.where(F.size("_v") == dim), max(dim, 1), {"_id": "bigint", "_label": "bigint"}, "_v"), []
    width = dim // parts
    for _ in range(rounds if books.size else 0):

        def work(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            sorted_, number, sums, computed = [Codebook(b) for b in books], np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64), 0
            for block in each_vectors(batches, (), dim):
                for p, book in enumerate(sorted_):
                    part = block.x[:, p * width : (p + 1) * width]
                    code, _, n = book.nearest(part)
                    found, counts, added = sums_by(code, part)
                    number[p, found] += counts
                    sums[p, found] += added
                    computed += n
            p, e = np.nonzero(number)
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(number[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([computed]), pa.array([np.zeros(width, np.int64)], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        books = books.copy()
        for (p, e), (n, total) in totals(blocks.mapInArrow(work, "part int, entry int, n bigint, sums array<bigint>"), ("part", "entry"), width).items():
            if p < 0:
                done.append(n)
            else:
                books[p, e] = total // n
    return blocks, books, done


def quantise(rows: DataFrame, entries: int = 256, rounds: int = 4, parts: int = 4, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (two hexadecimal digits for each part), error, label_error, codebooks_sha256.

    Rows whose vector is null, empty, or holds null or non-finite components are left out, and so are those whose length
    isn't that of the vector with the smallest id or can't be cut into `parts`.  Rows without an id take part as any
    other, after those with one in the order for the first entries; repeated rows count as often as they stand.  Fewer
    vectors than entries make as many entries; none make no rows.  Ties go to the lower entry.
    """
    return codes(*fit(rows, entries, rounds, parts, key, vector, label))


def codes(blocks: DataFrame, books: np.ndarray, _done: list[int]) -> DataFrame:
    """The result rows of fitted blocks."""
    parts, width = books.shape[0], books.shape[2]
    if not books.size:
        return blocks.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_ = [Codebook(b) for b in books]
        for block in each_vectors(batches, ("_id", "_label"), parts * width):
            found = [book.nearest(block.x[:, p * width : (p + 1) * width]) for p, book in enumerate(sorted_)]
            code = ["".join(f"{c:02x}" for c in row) for row in np.stack([c for c, _, _ in found], 1).tolist()]
            yield pa.RecordBatch.from_arrays([block.with_["_id"], block.with_["_label"], pa.array(code, pa.string()), pa.array(sum(e for _, e, _ in found))], ["vec_id", "_label", "code", "error"])

    coded = cut(blocks.mapInArrow(work, "vec_id bigint, _label bigint, code string, error bigint"), "codes")
    release(blocks)
    # one row a label: Spark broadcasts them if their written size allows it, and splits a hot label's rows otherwise
    per = cut(coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error")), "label-errors")
    said = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return coded.join(per, F.col("_label").eqNullSafe(F.col("_of"))).select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
