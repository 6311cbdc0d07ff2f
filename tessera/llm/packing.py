"""Hierarchical multi-length packing (operator 4).

Documents are routed, by their token counts, to tiers of context sizes (each a power of two up to the
longest window).  A document longer than the longest window gives whole windows and a rest; what is
left goes to the tier that just holds it.  Each tier closes sequences of its own size over a bounded
pool: its oldest piece, then whatever fits the gap best, from its own tier down to the shortest; where
nothing whole fits, a document is cut at the gap.  Closed sequences of a tier are dealt into step groups
of equally many tokens (they differ by one sequence at most) over all tasks.

Each task packs its own documents (no shuffle of texts), and closes its last pieces, less than a sequence
of their tier, in sequences of ever smaller powers of two, so nothing is padded: cost and memory don't
depend on how many documents share a source.  Packed pieces are written once; the sequences counted there
by task and tier number the groups.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed as
they come, and so are rows with a null id; ids may be of any type; the tables' other columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import col, cut, slices
from .tokens import crc, encoder

LOCAL_BITS = 36


class Packer:
    """Packs pieces of one task; yields closed sequences as (tier, [(row, start, length)])."""

    def __init__(self, longest: int, tiers: tuple[int, ...], pool: int):
        self.longest, self.tiers, self.pool = longest, tiers, pool
        self.waiting: dict[int, list] = {t: [] for t in tiers}  # sorted (length, -order of arrival, row, start)
        self.tokens = dict.fromkeys(tiers, 0)
        self.arrived = 0

    def tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def put(self, row, start: int, length: int) -> None:
        t = self.tier(length)
        self.arrived += 1
        insort(self.waiting[t], (length, -self.arrived, row, start))
        self.tokens[t] += length

    def take(self, t: int, i: int):
        length, _, row, start = self.waiting[t].pop(i)
        self.tokens[t] -= length
        return row, start, length

    def add(self, row, n: int) -> Iterator[tuple[int, list]]:
        whole = n // self.longest * self.longest
        for start in range(0, whole, self.longest):
            yield self.longest, [(row, start, self.longest)]
        if n > whole:
            self.put(row, whole, n - whole)
            t = self.tier(n - whole)
            while self.tokens[t] >= self.pool * t:
                yield t, self.fill(t)

    def fill(self, size: int) -> list:
        """One full sequence: the oldest piece of its tier, from there down the longest whole pieces that fit, then cut ones."""
        out, room = [], size
        if own := self.waiting.get(size):
            out.append(self.take(size, max(range(len(own)), key=lambda i: own[i][1])))
            room -= out[0][2]
        for t in reversed(self.tiers):
            while room and (i := bisect_right(self.waiting[t], (room, 1))):
                out.append(self.take(t, i - 1))
                room -= out[-1][2]
        for t in self.tiers:
            while room and self.waiting[t]:
                row, start, length = self.take(t, 0)
                cut = min(room, length)
                out.append((row, start, cut))
                room -= cut
                if cut < length:
                    self.put(row, start + cut, length - cut)
        return out

    def rest(self) -> Iterator[tuple[int, list]]:
        """The last pieces: full sequences of every tier, then of ever smaller powers of two."""
        for t in reversed(self.tiers):
            while self.waiting[t] and sum(self.tokens[x] for x in self.tiers if x <= t) >= t:
                yield t, self.fill(t)
        while (left := sum(self.tokens.values())) > 0:
            size = min(self.longest, 1 << (left.bit_length() - 1))
            yield size, self.fill(size)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 2048, tiers: tuple[int, ...] = (16, 64, 256, 512, 1024, 2048), pool: int = 64, step_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, ids.

    A sequence's length is a power of two: its tier, or, at a task's end, what is left for it.
    `step_group` numbers groups of sequences of one tier, as near to `step_tokens` tokens as the tier's total divides
    evenly; no two tiers share a number.
    """
    assert longest == tiers[-1] and list(tiers) == sorted(set(tiers)) and all(t & (t - 1) == 0 for t in tiers)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << LOCAL_BITS
        encode, packer, made, closed_of = encoder(tokenizer), Packer(longest, tiers, pool), 0, {}
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "nth", "ids"]
        rows: list[tuple] = []

        def emit(closed: Iterator[tuple[int, list]]) -> None:
            nonlocal made
            for tier, pieces in closed:
                offset, nth = 0, closed_of.get(tier, 0)
                for (doc, ids), start, length in pieces:
                    part = ids[start : start + length]
                    rows.append((doc, start, length, crc(part), len(ids), base + made, offset, tier, nth, part.astype("<u4").tobytes()))
                    offset += length
                made += 1
                closed_of[tier] = nth + 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:9]), pa.array(columns[9], pa.binary())], names)
            rows.clear()
            return out

        for part in slices(batches, "_text"):
            for doc, text in zip(col(part, "_id").to_pylist(), col(part, "_text").to_pylist(), strict=True):
                ids = np.append(encode.ids(text), np.uint32(end_id))
                emit(packer.add((doc, ids), len(ids)))
            if len(rows) >= 1000:
                yield flush()
        emit(packer.rest())
        if rows:
            yield flush()

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind_sql = picked.schema["_id"].dataType.simpleString()
    kind = to_arrow_type(picked.schema["_id"].dataType)
    packed = picked.mapInArrow(work, f"`{id_col}` {kind_sql}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, nth long, ids binary")
    return in_groups(cut(packed, "packed"), step_tokens)


def in_groups(packed: DataFrame, step_tokens: int) -> DataFrame:
    """packed with step_group for nth (of a task's sequences of a tier): each tier's sequences, over all tasks, in runs
    that differ by one sequence at most."""
    task = F.shiftright("sequence_id", LOCAL_BITS)
    counts = packed.where("offset = 0").groupBy(task.alias("task"), "tier").agg(F.count("*").alias("n")).collect()
    totals: dict[int, int] = {}
    before = []
    for r in sorted(counts, key=lambda r: (r["tier"], r["task"])):
        before.append((r["task"], r["tier"], totals.get(r["tier"], 0)))
        totals[r["tier"]] = totals.get(r["tier"], 0) + r["n"]
    rows = [(t, tier, n, totals[tier], max(1, round(totals[tier] * tier / step_tokens))) for t, tier, n in before]
    starts = packed.sparkSession.createDataFrame(rows, "task long, tier long, before long, total long, groups long")
    number = F.expr(f"(cast(log2(tier) as long) << {LOCAL_BITS}) + (before + nth) * groups div total")
    both = packed.withColumn("task", task).join(F.broadcast(starts), ["task", "tier"])
    return both.select(*(number.alias("step_group") if c == "nth" else c for c in packed.columns))
