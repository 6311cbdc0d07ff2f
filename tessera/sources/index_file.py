"""The binary index format as a data source: spark.read / df.write .format("chunk_index").

A file, all numbers unsigned, of 32 bits and little-endian::

    "RAG3"  chunk count  dimension
    for each chunk: source, text, kind, file, domain (each its length in bytes, then UTF-8), then `dimension` 32-bit floats
    optionally a graph: node count  greatest level  entry point (2**32 - 1: none)  m
    for each node: level, then for each layer from 0 to it: neighbour count, neighbours

Each task writes one file, under a temporary name until the job commits, so a lost task or a failed job leaves none
behind that a reader would see.  Reading takes one task a file (records have no marks to split at) and holds a batch
of rows.  A missing folder, a file shorter than its header and one with another beginning are empty; a file that ends
too early is an error.  option("part", "graph") reads the graph: node, layer, neighbours.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed values of the format.
MAGIC, NONE = b"RAG3", 0xFFFFFFFF
STRINGS = ("source", "text", "kind", "file", "domain")
CHUNKS = "source string, text string, kind string, file string, domain string, vector array<float>"
GRAPH = "node bigint, layer int, neighbours array<bigint>"
#: Rows of a batch.
ROWS = 1024


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


class Cursor:
    """Numbers and bytes of a file, in order."""

    def __init__(self, file, size: int):
        self.file, self.left = file, size

    def take(self, n: int, what: str) -> bytes:
        if n > self.left:
            raise ValueError(f"truncated at {what}")
        self.left -= n
        return self.file.read(n)

    def number(self, what: str) -> int:
        return struct.unpack("<I", self.take(4, what))[0]


@dataclass
class File(InputPartition):
    path: str
    size: int


class IndexReader(DataSourceReader):
    def __init__(self, path: str, part: str):
        self.path, self.part = path, part

    def partitions(self) -> list[File]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [File(f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._"] or [File("", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.size < 12:
            return
        system, _ = opened(self.path)
        with system.open_input_stream(partition.path, buffer_size=1 << 20) as file:
            at = Cursor(file, partition.size)
            if at.take(4, "header") != MAGIC:
                return
            count, dim = at.number("header"), at.number("header")
            columns: list[list] = [[] for _ in range(6)]
            for i in range(count):
                for column, name in zip(columns, STRINGS, strict=False):
                    column.append(at.take(at.number(f"chunk {i} ({name} len)"), f"chunk {i} ({name})").decode("utf-8", "replace"))
                columns[5].append(np.frombuffer(at.take(4 * dim, f"chunk {i} (vector)"), "<f4"))
                if self.part == "chunks" and (len(columns[5]) == ROWS or i == count - 1):
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:5]), pa.array(columns[5], pa.list_(pa.float32()))], [*STRINGS, "vector"])
                if len(columns[5]) == ROWS:
                    columns = [[] for _ in range(6)]
            if self.part == "graph" and at.left:
                yield from self._graph(at)

    @staticmethod
    def _graph(at: Cursor) -> Iterator[pa.RecordBatch]:
        if at.left < 16:
            raise ValueError("truncated at the graph's header")
        nodes, *_ = (at.number("graph") for _ in range(4))
        rows: list[tuple[int, int, np.ndarray]] = []
        for node in range(nodes):
            for layer in range(at.number(f"node {node} (level)") + 1):
                rows.append((node, layer, np.frombuffer(at.take(4 * at.number(f"node {node} layer {layer}"), f"node {node} layer {layer} neighbours"), "<u4").astype(np.int64)))
            if rows and (len(rows) >= ROWS or node == nodes - 1):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["node", "layer", "neighbours"])
                rows = []


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class IndexWriter(DataSourceArrowWriter):
    """Rows go to the file as they come; the chunk count is set at the end of the task."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        name = f"{self.job}-{context.partitionId():05d}"
        temporary, body = f"{path}/_{name}-{context.taskAttemptId()}", f"{path}/_{name}-{context.taskAttemptId()}-body"
        count, dim = 0, None
        with system.open_output_stream(body) as out:
            for batch in batches:
                for row in batch.select([*STRINGS, "vector"]).to_pylist():
                    vector = np.asarray(row["vector"] or [], "<f4")
                    if dim not in (None, len(vector)):
                        raise ValueError(f"vectors have {dim} and {len(vector)} dimensions")
                    dim = len(vector)
                    for name_ in STRINGS:
                        text = (row[name_] or "").encode()
                        out.write(struct.pack("<I", len(text)) + text)
                    out.write(vector.tobytes())
                    count += 1
        with system.open_output_stream(temporary) as out:  # the count is known only now, and streams can't go back
            out.write(MAGIC + struct.pack("<II", count, dim or 0))
            with system.open_input_stream(body) as done:
                while part := done.read(1 << 22):
                    out.write(part)
        system.delete_file(body)
        return Written(temporary, f"{path}/part-{name}")

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file and f.base_name.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m is not None:
                system.move(m.temporary, m.final)
        for f in old:
            system.delete_file(f)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}"):
                system.delete_file(f.path)


class ChunkIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_index"

    def schema(self) -> str:
        return GRAPH if self.options.get("part") == "graph" else CHUNKS

    def reader(self, schema) -> IndexReader:
        return IndexReader(self.options["path"], self.options.get("part", "chunks"))

    def writer(self, schema, overwrite: bool) -> IndexWriter:
        return IndexWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkIndex)
