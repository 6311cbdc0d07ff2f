"""Shared pieces of the corpus operators: table access, lineage cuts, numpy text primitives.

Texts arrive as Arrow batches.  Everything here works on one slice of a batch (about
``SLICE_BYTES`` of text, or one document where a document is longer), so memory in a worker
is bounded by the slice or by the longest single document, never by a group of documents.
"""

from __future__ import annotations

import atexit
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on.
SLICE_BYTES = 1 << 21
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package; clusters get it by --py-files."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, in a session of one machine, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def write(df: DataFrame, path: str) -> None:
    """Without dictionaries: what is written here is mostly hashes and packed arrays.  A column `kind` gets folders."""
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").partitionBy(*["kind"] * ("kind" in df.columns)).parquet(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage ends there."""
    path = new_path(df.sparkSession, name)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(df: DataFrame) -> None:
    """Deletes a table made by cut() that nothing reads any more."""
    entry = df.sparkSession, getattr(df, "_written_at", None)
    if entry in _written:
        drop_path(*entry)
        _written.remove(entry)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended; the folder belongs to it
            return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- texts of an Arrow batch -------------------------------------------------------------


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end, and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    at = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about `most` bytes in `column`, at least one row each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, at = as_bytes(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            yield batch.slice(lo, min(hi, n) - lo)
            lo = min(hi, n)


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return col(batch, name).cast(pa.int64()).to_numpy(zero_copy_only=False)


# --- hashing -----------------------------------------------------------------------------

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = 0x9E3779B97F4A7C15
U64 = (1 << 64) - 1


#: Elements that one step of a pass works on, so that its arrays stay in the processor's cache.
STEP = 1 << 14
TURNS = tuple(map(np.uint64, (30, 27, 31)))


def stir(x: np.ndarray, other: np.ndarray) -> None:
    """mix() in place; other: room for as many numbers."""
    for turn, by in zip(TURNS, (M1, M2, None), strict=True):
        np.right_shift(x, turn, out=other)
        np.bitwise_xor(x, other, out=x)
        if by is not None:
            np.multiply(x, by, out=x)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    out = np.array(x, np.uint64)
    flat, room = out.reshape(-1), np.empty(min(out.size, STEP), np.uint64)
    for lo in range(0, out.size, STEP):
        part = flat[lo : lo + STEP]
        stir(part, room[: len(part)])
    return out


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1000003)) * np.uint64(GOLD))


class Rolling:
    """Polynomial hashes, modulo 2**64, of any stretch of a symbol sequence, by one running sum.

    Bytes are first replaced by random 64-bit numbers, and results go through mix(), so that
    neither short stretches nor low bits are weak.  Two seeds give independent hashes.
    """

    def __init__(self, seed: int):
        self.seed = seed
        self.base = int(seeded(seed, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.byte = seeded(seed + 7, 256)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def __reduce__(self):
        return rolling, (self.seed,)  # tasks use their process's own tables, and these aren't shipped

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << max(12, (n - 1).bit_length())
            for name, step in (("powers", self.base), ("inverses", self.inverse)):
                out = np.full(size, step, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        """Running sums with a leading 0, of symbols (uint8, or uint64 hashes)."""
        n = len(symbols)
        self._grow(n + 1)
        out, room = np.zeros(n + 1, np.uint64), np.empty(min(n, STEP), np.uint64)
        for lo in range(0, n, STEP):
            part = symbols[lo : lo + STEP]
            t = room[: len(part)]
            if symbols.dtype == np.uint8:
                np.take(self.byte, part, out=t, mode="clip")
                part = t
            np.multiply(part, self.powers[lo : lo + len(t)], out=t)
            t[:1] += out[lo : lo + 1]
            np.cumsum(t, out=out[lo + 1 : lo + 1 + len(t)])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(sums))
        return mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64) * np.uint64(GOLD))

    def windows(self, sums: np.ndarray, size: int) -> np.ndarray:
        """The hash of every `size` consecutive symbols."""
        n = len(sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._grow(n)
        out, room = np.empty(n, np.uint64), np.empty(min(n, STEP), np.uint64)
        for lo in range(0, n, STEP):
            part = out[lo : lo + STEP]
            hi = lo + len(part)
            np.subtract(sums[size + lo : size + hi], sums[lo:hi], out=part)
            np.multiply(part, self.inverses[lo:hi], out=part)
            stir(part, room[: len(part)])
        return out


@functools.cache
def rolling(seed: int) -> Rolling:
    return Rolling(seed)


#: Two hashes over bytes, and two over words.
R1, R2, N1, N2 = map(rolling, (1, 2, 3, 4))

# --- words -------------------------------------------------------------------------------

#: Bytes of `[^\x20\x09-\x0D]+`.
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and all of UTF-8 beyond ASCII.
ITEM_WORD = np.zeros(256, bool)
ITEM_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Words of a run of documents: start, end (bytes), first (n + 1 offsets into the words)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, letters: np.ndarray = WORD):
        inside = letters[raw]
        edge = np.zeros(len(raw) + 1, bool)  # between the byte before and this one
        edge[1:-1] = inside[1:] != inside[:-1]
        if len(raw):
            edge[0], edge[-1] = inside[0], inside[-1]
            borders = at[(at > 0) & (at < len(raw))]
            both = borders[inside[borders] & inside[borders - 1]]
        else:
            both = at[:0]
        flips = np.flatnonzero(edge)
        if len(both):  # a word ends and the next begins where two documents meet
            flips = np.sort(np.concatenate([flips, np.repeat(np.unique(both), 2)]))
        self.raw, self.at = raw, at
        self.start, self.end = flips[::2], flips[1::2]
        self.first = np.searchsorted(self.start, at)
        self.first[-1] = len(self.start)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))

    def hashes(self, rolling: Rolling = R1) -> np.ndarray:
        return rolling.spans(rolling.sums(self.raw), self.start, self.end)

    def fits(self, size: int) -> np.ndarray:
        """Which of the len - size + 1 windows lie in one document."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, bool)
        doc = self.doc()
        return doc[size - 1 :] == doc[:n]


def cover(flags: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n symbols lie in a flagged window of `size`."""
    step = np.zeros(n + 1, np.int32)
    hit = np.flatnonzero(flags)
    np.add.at(step, hit, 1)
    np.subtract.at(step, hit + size, 1)
    return np.cumsum(step[:n]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys are found twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    return member(keys, np.unique(twice))


def member(keys: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which keys are in the set.  Most keys that aren't are told by a table of the set's low bits."""
    if not len(sorted_set):
        return np.zeros(len(keys), bool)
    mask = np.uint64((1 << min(24, len(sorted_set).bit_length() + 3)) - 1)
    table = np.zeros(int(mask) + 1, bool)
    table[sorted_set & mask] = True
    out = table[keys & mask]
    likely = np.flatnonzero(out)
    at = np.searchsorted(sorted_set, keys[likely])
    at[at == len(sorted_set)] = 0
    out[likely] = sorted_set[at] == keys[likely]
    return out


def in_doc(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys made distinct between documents."""
    return mix(keys + doc.astype(np.uint64) * np.uint64(GOLD))


def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over stretches at[i]..at[i+1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true stretches."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def slide_min(x: np.ndarray, size: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or what pick says) of every `size` consecutive values, by doubling."""
    n = len(x) - size + 1
    if n <= 0:
        return x[:0]
    out = np.empty(n, x.dtype)
    for lo in range(0, n, STEP):
        part = out[lo : lo + STEP]
        have, y = 1, x[lo : lo + len(part) + size - 1]
        while have * 2 <= size:
            y = pick(y[:-have], y[have:])
            have *= 2
        pick(y[: len(part)], y[size - have : size - have + len(part)], out=part)
    return out


def winnow(grams: np.ndarray, size: int, low: np.ndarray | None = None) -> np.ndarray:
    """Positions of grams that are the minimum of some `size` consecutive ones (all equal minima)."""
    low = slide_min(grams, size) if low is None else low
    if not len(low):
        return np.zeros(0, np.int64)
    # grams[i] is kept if it equals the largest of the window minima over windows that hold it
    padded = np.zeros(len(low) + 2 * (size - 1), grams.dtype)
    padded[size - 1 : size - 1 + len(low)] = low
    return np.flatnonzero(grams == slide_min(padded, size, np.maximum))
