"""Chunked response bodies as a stream: a source of the bytes that files grow by, and stateful decoding with an end.

The source's offsets are the sizes of the files, so a batch is given by them alone and can be read again.  What a
batch leaves unfinished, a chunk header, a chunk or a line that is cut in the middle, is kept in the stream's state,
which Spark restores with the offsets: after a restart every line comes once.  A body ends with its chunk of size 0, a
[DONE], or when nothing came for a while; then its state goes.

The stateful operators need a state store that can set timers; session() of this module sets it.  Timers need batches:
run them with a processing-time trigger.  (With availableNow, which ends when no batch is due, set
spark.sql.streaming.noDataMicroBatches.enabled to false, as timers make another batch due at any time.)
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.index_file import opened

#: Bytes that one row and one task of the source hold at most.
PIECE, TASK = 1 << 16, 1 << 24
BYTES = "stream string, at bigint, piece binary"
LINES, CALLS = ("stream", "n", "line"), ("stream", "index", "id", "name", "arguments")
#: Milliseconds without anything new after which a stream is over, and for which its end is remembered.
IDLE, REMEMBERED = 600_000, 3_600_000


def session(spark: SparkSession) -> SparkSession:
    """Sets the state store that timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


@dataclass
class Range(InputPartition):
    path: str
    stream: str
    start: int
    end: int


class BodyReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _sizes(self) -> dict[str, int]:
        system, path = opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.is_file and f.base_name[0] not in "._"}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(sorted(self._sizes().items()))

    def partitions(self, start: dict, end: dict) -> list[Range]:
        system, path = opened(self.path)
        out = []
        for name, size in end.items():
            begin = start.get(name, 0)
            if size < begin:
                raise ValueError(f"{name} had {begin} bytes and has {size}")
            out += [Range(f"{path}/{name}", name, at, min(at + TASK, size)) for at in range(begin, size, TASK)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as file:
            for at in range(partition.start, partition.end, PIECE):
                piece = file.read_at(min(PIECE, partition.end - at), at)
                yield pa.RecordBatch.from_arrays([pa.array([partition.stream]), pa.array([at]), pa.array([piece])], ["stream", "at", "piece"])

    def commit(self, end: dict) -> None:
        """Files stay; who writes them may delete those that are over."""


class Bodies(DataSource):
    """spark.readStream.format("bodies").load(folder): a file is a stream, and grows."""

    @classmethod
    def name(cls) -> str:
        return "bodies"

    def schema(self) -> str:
        return BYTES

    def streamReader(self, schema) -> BodyReader:
        return BodyReader(self.options["path"])


def register(spark: SparkSession) -> None:
    session(spark).dataSource.register(Bodies)


class Decoder:
    """A chunked body as it comes: feed() gives its whole lines; rest, left, head and over are all there is to keep."""

    def __init__(self, rest: bytes = b"", left: int = 0, head: bytes = b"", over: bool = False):
        self.rest, self.left, self.head, self.over = rest, left, head, over

    def feed(self, piece: bytes) -> list[str]:
        at, said = 0, [self.rest]
        while at < len(piece) and not self.over:
            if self.left:
                part = piece[at : at + self.left]
                said.append(part)
                at, self.left = at + len(part), self.left - len(part)
                continue
            end = piece.find(b"\n", at)
            self.head += piece[at : end if end >= 0 else len(piece)]
            at = end + 1 if end >= 0 else len(piece)
            if end >= 0 and (head := self.head.replace(b"\r", b"").strip()):
                self.left = int(head, 16) if re.fullmatch(rb"[0-9a-fA-F]+", head) else 0
                self.over = not self.left
            if end >= 0:
                self.head = b""
        *lines, self.rest = b"".join(said).split(b"\n")
        if self.over and self.rest:
            lines, self.rest = [*lines, self.rest], b""
        return [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]


def table(columns: tuple[str, ...], rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns, dtype=object)


def later(handle: StatefulProcessorHandle, ms: int) -> None:
    """One timer, `ms` from now."""
    for old in handle.listTimers():
        handle.deleteTimer(old)
    handle.registerTimer(int(time.time() * 1000) + ms)


class Lines(StatefulProcessor):
    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "next bigint, n bigint, rest binary, left bigint, head binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pieces = sorted((r.at, bytes(r.piece)) for part in rows for r in part.itertuples())
        known = self.kept.get() if self.kept.exists() else None
        if known is None and pieces[0][0]:
            return  # the stream was over before: its late bytes are left out
        upto, n, rest, left, head = known or (0, 0, b"", 0, b"")
        decoder, lines = Decoder(bytes(rest), left, bytes(head)), []
        for at, piece in pieces:
            if at != upto:
                raise ValueError(f"{key[0]}: bytes from {upto} to {at} are missing")
            lines += decoder.feed(piece)
            upto += len(piece)
            if decoder.over or "data: [DONE]" in lines:
                decoder.over = True
                break
        if "data: [DONE]" in lines:
            lines = lines[: lines.index("data: [DONE]") + 1]
        yield table(LINES, [(key[0], n + i, x) for i, x in enumerate(lines)])
        if decoder.over:
            self.forget()
        else:
            self.kept.update((upto, n + len(lines), decoder.rest, decoder.left, decoder.head))
            later(self.handle, self.idle)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Nothing came for a while: a line that was not ended is the last, and the state goes."""
        if self.kept.exists():
            _, n, rest, _, _ = self.kept.get()
            self.kept.clear()
            yield table(LINES, [(key[0], n, bytes(rest).decode("utf-8", "replace"))] if rest else [])

    def forget(self) -> None:
        self.kept.clear()
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)

    def close(self) -> None:
        pass


def body_lines(pieces: DataFrame, idle: int = IDLE) -> DataFrame:
    """stream, at, piece (a stream) -> stream, n, line: the decoded bodies' lines, each once, as they are ended.

    A body is over with its chunk of size 0, with a line `data: [DONE]` (lines behind it are left out), or after `idle`
    milliseconds without bytes.  What comes for a stream that is over is left out, for ever: it doesn't begin at byte 0.
    """
    return pieces.groupBy("stream").transformWithStateInPandas(Lines(idle), "stream string, n long, line string", "append", "processingTime")


class Calls(StatefulProcessor):
    def __init__(self, idle: int, remembered: int):
        self.idle, self.remembered = idle, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "index int", "id string, name string")
        self.parts = handle.getListState("parts", "index int, seq bigint, arguments string")
        self.over = handle.getValueState("over", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.over.exists():
            return  # late fragments of a stream whose calls are out
        done, got = False, []
        for r in sorted((r for part in rows for r in part.itertuples()), key=lambda r: r.seq):
            if r.done:
                done = True
                break
            id_, name = self.names.getValue((int(r.index),)) if self.names.containsKey((int(r.index),)) else ("", "")
            self.names.updateValue((int(r.index),), (r.id if isinstance(r.id, str) else id_, r.name if isinstance(r.name, str) else name))
            if isinstance(r.arguments, str):
                got.append((int(r.index), int(r.seq), r.arguments))
        if got:
            self.parts.appendList(got)
        if done:
            yield self.finished(key)
        else:
            later(self.handle, self.idle)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.over.exists():
            self.over.clear()
        else:
            yield self.finished(key)

    def finished(self, key: tuple) -> pd.DataFrame:
        parts = sorted(self.parts.get()) if self.parts.exists() else []
        calls = sorted((k[0], *v) for k, v in self.names.iterator()) if self.names.exists() else []
        self.names.clear(), self.parts.clear()
        self.over.update((int(time.time() * 1000),))
        later(self.handle, self.remembered)
        return table(CALLS, [(key[0], i, id_, name, "".join(a for j, _, a in parts if j == i)) for i, id_, name in calls])

    def close(self) -> None:
        pass


def finished_calls(fragments: DataFrame, idle: int = IDLE, remembered: int = REMEMBERED) -> DataFrame:
    """stream, seq, index, id, name, arguments, done (a stream) -> the calls of each stream, whole, once it is over.

    A stream is over with a row that is `done`, or after `idle` milliseconds without rows; its state goes but for the mark
    that it is over, which lasts `remembered` milliseconds.  Fragments that come meanwhile are late and left out; those
    that come after it begin a new stream of that name.
    """
    return fragments.groupBy("stream").transformWithStateInPandas(Calls(idle, remembered), "stream string, index int, id string, name string, arguments string", "append", "processingTime")
