"""Token-id files in Simple-8b word-aligned coding (operator 5).

A block of up to `BLOCK` ids is a run of 64-bit words.  The top four bits of a word select how many ids
it holds and in how many bits each (the table below); ids that need more than the widest field are
written as an escape word followed by the raw id.  A file has a header, the document index, the offset
and id count of every block, then the words; blocks decode independently and, within a block, all words
with one selector decode in one vectorised step.

Writing: documents are range-partitioned by id (a task's memory holds one file, of about `FILE_IDS` ids),
each task writes whole files under names of its own attempt, and returns one manifest row per file;
only files in the manifest count, so a lost executor or a second attempt leaves nothing half-written in
the result.  File names, not texts, go through the driver.

Defined results: null or empty texts are the end id alone; ties of ids (repeated rows) stay in one
stretch, ordered by text; rows with a null id come first (a file's header counts them); an empty table gives an
empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, cut, new_path, slices
from .tokens import crc, encoder

#: Fixed values of the coding: ids in a word and bits of each, by selector (2 to 15); 0 is the escape.
COUNT = np.array([0, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
SPAN = np.maximum(COUNT, 1).astype(np.uint8)
LIMITS = np.uint64(1) << WIDTH[2:].astype(np.uint64)
BLOCK = 1 << 14
FILE_IDS = 1 << 22
#: Bytes of text whose distinct words are encoded at once.
ENCODE_BYTES = 1 << 23
MAGIC = b"TS8B\x02\0\0\0"
HEAD = struct.Struct("<QQQQI")


def encode_block(ids: np.ndarray) -> np.ndarray:
    """The words of one block."""
    n = len(ids)
    ids = np.asarray(ids, np.uint64)
    # the narrowest selector that holds each id, then the widest need of as many ids as a word holds
    need = (np.searchsorted(LIMITS, ids, "right") + 2).astype(np.uint8)
    fitting = np.zeros(n, np.uint8)  # how many selectors fit if a word began at each id: where one does, so do all less dense
    held = 1
    for s in range(15, 1, -1):
        size = int(COUNT[s])
        if size > n:
            break
        need, held = np.maximum(need[: n - size + 1], need[size - held :]), size
        fits = need <= s
        if not fits.any():
            break
        fitting[: len(fits)] += fits
    best = np.where(fitting == 0, 0, 16 - fitting)  # the densest
    span, begins, at = SPAN[best].tobytes(), bytearray(n), 0
    while at < n:
        begins[at] = 1
        at += span[at]
    starts = np.flatnonzero(np.frombuffer(begins, np.uint8))
    chosen = best[starts]
    room = 1 + (chosen == 0)
    place = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint64)
    for s in np.unique(chosen):
        mine = chosen == s
        if s == 0:
            out[place[mine] + 1] = ids[starts[mine]]
            continue
        first = starts[mine]
        word = np.full(len(first), np.uint64(s) << np.uint64(60))
        for j in range(int(COUNT[s])):
            word |= ids[first + j] << np.uint64(j * int(WIDTH[s]))
        out[place[mine]] = word
    return out


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    if (selector == 0).any():  # the word after an escape is a raw id
        at = 0
        for at in np.flatnonzero(selector == 0):
            if head[at] and at + 1 < len(words):
                head[at + 1] = False
    where = np.flatnonzero(head)
    chosen = selector[where]
    size = np.where(chosen == 0, 1, COUNT[chosen])
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(chosen):
        mine = chosen == s
        if s == 0:
            out[start[mine]] = words[where[mine] + 1]
            continue
        word, mask = words[where[mine]], np.uint64((1 << int(WIDTH[s])) - 1)
        for j in range(int(COUNT[s])):
            out[start[mine] + j] = (word >> np.uint64(j * int(WIDTH[s]))) & mask
    assert len(out) == n, "a block's words and its id count differ"
    return out


def file_image(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, nameless: int = 0) -> bytes:
    """A file's bytes; its first `nameless` documents have no id (whatever doc_ids holds there)."""
    blocks = [encode_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    body = b"".join([doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), offsets.tobytes(), *(b.astype("<u8").tobytes() for b in blocks)])
    return MAGIC + HEAD.pack(len(doc_ids), nameless, len(ids), len(blocks), zlib.crc32(body)) + body


def nameless_in(data: bytes) -> int:
    """How many documents of a file, its first, have no id."""
    return HEAD.unpack_from(data, len(MAGIC))[1]


def read_image(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, id counts, and all ids of a file."""
    assert data[:8] == MAGIC, "not a token-id file"
    docs, _, total, blocks, check = HEAD.unpack_from(data, len(MAGIC))
    at = len(MAGIC) + HEAD.size
    assert zlib.crc32(memoryview(data)[at:]) == check, "a token-id file is damaged"
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    offsets = np.frombuffer(data, "<u8", blocks + 1, at + 12 * docs).astype(np.int64)
    words = np.frombuffer(data, "<u8", int(offsets[-1]), at + 12 * docs + 8 * (blocks + 1))
    parts = [decode_block(words[offsets[i] : offsets[i + 1]], min(BLOCK, total - i * BLOCK)) for i in range(blocks)]
    return doc_ids, counts.astype(np.int64), np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes token-id files in ascending id order; returns the manifest: shard, seq, file, n_docs, n_ids, first_doc."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    count = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the start of the text lets many rows of one id (or without one) be dealt to several tasks
    ordered = picked.repartitionByRange(count, F.col("_id"), F.substring("_text", 1, 32)).sortWithinPartitions("_id", "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        where, root = filesystem(folder)
        where.create_dir(root, recursive=True)
        docs_, counts, ids, held, seq = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, seq
            name = f"{shard:06d}-{seq:06d}-{uuid.uuid4().hex}.s8b"
            with where.open_output_stream(f"{root}/{name}") as out:
                named = [x for x in docs_ if x is not None]
                out.write(file_image(np.array([0] * (len(docs_) - len(named)) + named, np.int64), np.concatenate(counts), np.concatenate(ids), len(docs_) - len(named)))
            row = [[shard], [seq], [name], [len(docs_)], [held], [docs_[0]]]
            docs_.clear(), counts.clear(), ids.clear()
            held, seq = 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["shard", "seq", "file", "n_docs", "n_ids", "first_doc"])

        for part in slices(batches, "_text", ENCODE_BYTES):
            doc, (got, size) = col(part, "_id").to_pylist(), encode.many(col(part, "_text").to_pylist())
            got, size = np.insert(got, np.cumsum(size), np.uint32(end_id)), size + 1
            ends, lo = np.cumsum(size), 0
            while lo < len(doc):  # a file ends with the document that fills it
                before = int(ends[lo - 1]) if lo else 0
                hi = min(int(np.searchsorted(ends, before + file_ids - held)) + 1, len(doc))
                docs_ += doc[lo:hi]
                counts.append(size[lo:hi]), ids.append(got[before : ends[hi - 1]])
                held, lo = held + int(ends[hi - 1]) - before, hi
                if held >= file_ids:
                    yield close()
        if docs_:
            yield close()

    return cut(ordered.mapInArrow(work, "shard long, seq long, file string, n_docs long, n_ids long, first_doc long"), "s8b-manifest")


def read_token_files(spark, folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids, from the files of a manifest.

    The manifest has one small row per file, so its running sum in one task is bounded by the number of
    files (about one per `FILE_IDS` ids).
    """
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = filesystem(folder)
        for batch in batches:
            for name, base in zip(col(batch, "file").to_pylist(), col(batch, "base").to_pylist(), strict=True):
                with where.open_input_stream(f"{root}/{name}") as file:
                    data = file.read()
                doc_ids, counts, ids = read_image(data)
                start = np.cumsum(counts) - counts
                crcs = [crc(ids[a : a + n]) for a, n in zip(start.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array(doc_ids, mask=np.arange(len(doc_ids)) < nameless_in(data)), pa.array(start + base), pa.array(counts), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a : a + n].tobytes() for a, n in zip(start.tolist(), counts.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return placed.select("file", "base").repartition(tasks, "file").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the files into the shared folder and reads every document's digest back from them."""
    folder = new_path(docs.sparkSession, "s8b")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, tokenizer, end_id), with_ids=False)
