"""Blocks of documents, and key exchange between them.

Operators that compare all documents with all others work on blocks: rows that each hold a few MB of
whole documents (texts compressed).  A block sends, for each key bucket, one message with its distinct
keys, so a key that a third of all documents hold is one entry a block; a bucket answers each block.
Messages are few and large, which is what keeps the JVM's share small.  A worker holds one block, or
one bucket's messages, at a time; blocks and buckets are sized from the input's bytes.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, col, cut, partitions, slices

#: Text of a block.  For inputs so large that a block's messages get short, give to_blocks more (up to 64 MB).
BLOCK_BYTES = 1 << 21
#: Text behind one bucket of keys.
BUCKET_TEXT = 1 << 25


def pack_text(raw: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw.tobytes())


def unpack_text(data: bytes, size: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=size) if size else b"", np.uint8)


def squeeze(x: np.ndarray, rising: bool = False) -> bytes:
    """Numbers by byte planes, compressed; rising ones by their differences."""
    import zstandard

    if rising:
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def loosen(data: bytes, kind=np.uint64, rising: bool = False) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    x = np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if rising else x


class Block:
    """block id, ids of its documents, their bytes end to end, n + 1 offsets."""

    def __init__(self, number: int, ids: bytes, offsets: bytes, text: bytes | None, rest: bytes | None = None, raw: np.ndarray | None = None):
        self.number, self.rest = number, rest
        self.ids, self.at = np.frombuffer(ids, np.int64), np.frombuffer(offsets, np.int64)
        self.raw = unpack_text(text, int(self.at[-1])) if raw is None else raw


def to_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES, batch: int = 0) -> DataFrame:
    """block, n_bytes, ids, offsets, text, rest (the columns of `carry`, as an Arrow stream).

    Written, so that a block is the same in every later stage.  Numbers hold the batch, the partition and a count.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = (batch << 44) + (TaskContext.get().partitionId() << 20), 0
        for part in slices(batches, "_text", block_bytes):
            raw, at = as_bytes(col(part, "_text"))
            ids = col(part, "_id").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([len(raw)], pa.int64()), pa.array([ids.tobytes()]), pa.array([at.tobytes()]), pa.array([pack_text(raw)]), pa.array([stream(part.select([f"_{x}_" for x in carry])) if carry else None], pa.binary())], ["block", "n_bytes", "ids", "offsets", "text", "rest"])
            made += 1

    picked = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *(F.col(x).alias(f"_{x}_") for x in carry))
    return cut(picked.mapInArrow(work, "block long, n_bytes long, ids binary, offsets binary, text binary, rest binary"), "blocks")


def stream(part: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(part)
    return sink.getvalue().to_pybytes()


def rest_of(data: bytes) -> list[pa.Array]:
    return [c.combine_chunks() for c in pa.ipc.open_stream(data).read_all().columns]


def bucket_count(blocks: DataFrame) -> int:
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(2 * partitions(blocks.sparkSession), -(-total // BUCKET_TEXT))


def task_count(blocks: DataFrame) -> int:
    """Tasks that exchanged messages are dealt to: about 8 MB of text each, two a core at least, no more than shuffle partitions or buckets."""
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return min(max(partitions(blocks.sparkSession), -(-total // BUCKET_TEXT)), max(2 * blocks.sparkSession.sparkContext.defaultParallelism, -(-total // (1 << 23))))


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(*(col(batch, x)[row].as_py() for x in ("block", "ids", "offsets", "text")))


def block_of(t: pa.Table) -> Block:
    return Block(*(t.column(x)[0].as_py() for x in ("block", "ids", "offsets", "text", "rest") if x in t.column_names))


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's stretch of sorted 64-bit keys begins; buckets are ranges of the key."""
    step = (1 << 64) // buckets + 1
    edges = np.array([i * step for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def messages(block: int, keys: np.ndarray, buckets: int, *more: np.ndarray) -> pa.RecordBatch | None:
    """One row per bucket that has keys: bucket, block, keys and the arrays that go with them."""
    bounds = bucket_bounds(keys, buckets)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return None
    arrays = [pa.array(full.astype(np.int64)), pa.array(np.full(len(full), block, np.int64))]
    for x in (keys, *more):
        arrays.append(pa.array([x[bounds[b] : bounds[b + 1]].tobytes() for b in full], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "block", "keys", *(f"more{i}" for i in range(len(more)))])


def send(blocks: DataFrame, work: Callable[[Block], pa.RecordBatch | None], more: int = 0, keys: str = "keys") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in each_block(batches):
            if (out := work(block)) is not None:
                yield out

    return blocks.select("block", "ids", "offsets", "text").mapInArrow(run, f"bucket long, block long, {keys} binary" + "".join(f", more{i} binary" for i in range(more)))


def joined(t: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """The rows' arrays end to end, and offsets."""
    parts = [np.frombuffer(x.as_py(), kind) for x in t.column(name)]
    at = np.cumsum([0, *map(len, parts)])
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), at


def tidy(spark) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referenced.

    The event of the last query holds its plan until listeners have seen it.
    """
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    gc.collect()
    jvm.System.gc()


def answer(blocks: DataFrame, replies: DataFrame, work: Callable[[Block, pa.Table], pa.RecordBatch | pa.Table], schema: str, rest: bool = False, tasks: int = 0) -> DataFrame:
    """Each block with the replies to it (a block without any gets an empty table).

    tasks: so many tasks.  Messages are small for the work that they cause, so Spark's own choice, by their bytes, would be one or two a core.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        out = work(block_of(left), right)
        return out if isinstance(out, pa.Table) else pa.Table.from_batches([out])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    left, right = (dealt(x, "block", tasks) for x in (blocks.select("block", "ids", "offsets", "text", *["rest"] * rest), replies))
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, schema)


def dealt(df: DataFrame, key: str, tasks: int) -> DataFrame:
    return df.repartition(tasks, key) if tasks else df
