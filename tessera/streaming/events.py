"""Decoding of model streams: chunked bodies, server-sent events, tool calls in fragments; incremental indexing; the read ledger.

Everything has a batch form over rows (stream, seq, line); the stateful forms run the same folds per key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X


CHUNK = "choices array<struct<delta:struct<content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>,finish_reason:string>>"


def decode_chunked(body: bytes) -> bytes:
    """The content of an HTTP chunked body; ends at a chunk of size 0, at a size that can't be read, or where data end."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\n", at)
        head = body[at : end if end >= 0 else len(body)].replace(b"\r", b"").strip()
        at = end + 1 if end >= 0 else len(body)
        if not head:
            continue
        size = int(head, 16) if re.fullmatch(rb"[0-9a-fA-F]+", head) else 0
        if not size:
            break
        out.append(body[at : at + size])
        at += size
    return b"".join(out)


def parse_sse(frames: DataFrame) -> DataFrame:
    """stream, seq, line -> stream, seq, delta, finish_reason of the first choice of every data line before [DONE].

    Lines that aren't data, or whose JSON can't be read, are skipped.
    """
    data = frames.where(F.startswith("line", F.lit("data: "))).withColumn("data", F.substring("line", 7, 1 << 30))
    before = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    live = data.withColumn("over", F.max((F.col("data") == "[DONE]").cast("int")).over(before)).where("over = 0")
    choice = F.get(F.from_json("data", CHUNK).choices, F.lit(0))
    return live.withColumn("c", choice).where("c is not null").select("stream", "seq", F.col("c.delta").alias("delta"), F.col("c.finish_reason").alias("finish_reason"))


def fold_fragments(fragments: DataFrame) -> DataFrame:
    """stream, seq, index, id, name, arguments -> one call per stream and index: the last id and name, and all
    argument fragments in order."""
    def last(column: str):
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq")))

    ordered = F.array_sort(F.collect_list(F.when(F.col("arguments").isNotNull(), F.struct("seq", "arguments"))))
    return fragments.groupBy("stream", "index").agg(
        F.coalesce(last("id"), F.lit("")).alias("id"), F.coalesce(last("name"), F.lit("")).alias("name"), F.array_join(F.transform(ordered, lambda x: x.arguments), "").alias("arguments")
    )


def fragments_of(events: DataFrame) -> DataFrame:
    calls = events.select("stream", "seq", F.explode("delta.tool_calls").alias("t"))
    return calls.select("stream", "seq", F.col("t.index").alias("index"), F.col("t.id").alias("id"), F.col("t.function.name").alias("name"), F.col("t.function.arguments").alias("arguments"))


def round_result(events: DataFrame) -> DataFrame:
    """stream, content, token_count, finish_reason of a whole stream."""
    said = F.col("delta.content")
    parts = F.array_sort(F.collect_list(F.when(F.length(said) > 0, F.struct("seq", said.alias("x")))))
    return events.groupBy("stream").agg(
        F.array_join(F.transform(parts, lambda p: p.x), "").alias("content"), F.count_if(F.length(said) > 0).alias("token_count"), F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason")
    )


def as_frames(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows as server-sent events."""
    return events.withColumn("frame", F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n")))


def stateful_calls(fragments: DataFrame) -> DataFrame:
    """The streaming form of fold_fragments: emits a key's call as far as it has come, in update mode."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        id_, name, text = state.get if state.exists else ("", "", "")
        for rows in batches:
            for row in rows.sort_values("seq").itertuples():
                id_ = row.id if isinstance(row.id, str) else id_
                name = row.name if isinstance(row.name, str) else name
                text += row.arguments if isinstance(row.arguments, str) else ""
        state.update((id_, name, text))
        yield pd.DataFrame({"stream": [key[0]], "index": [key[1]], "id": [id_], "name": [name], "arguments": [text]})

    return fragments.groupBy("stream", "index").applyInPandasWithState(fold, "stream string, index int, id string, name string, arguments string", "id string, name string, arguments string", "update", GroupStateTimeout.NoTimeout)


def split_frames(pieces: DataFrame) -> DataFrame:
    """stream, seq, piece -> stream, n, frame: frames end with an empty line; a part at the end waits for the next piece."""

    def cut(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, n = state.get if state.exists else ("", 0)
        for rows in batches:
            *whole, rest = (rest + "".join(rows.sort_values("seq")["piece"])).split("\n\n")
            yield pd.DataFrame({"stream": key[0], "n": range(n, n + len(whole)), "frame": whole})
            n += len(whole)
        state.update((rest, n))

    return pieces.groupBy("stream").applyInPandasWithState(cut, "stream string, n long, frame string", "rest string, n long", "append", GroupStateTimeout.NoTimeout)


def read_ledger(reads: DataFrame) -> DataFrame:
    """path, seq, hash, total, a, b -> path, seq, seen, read, unread: whether lines a to b were read before of this
    content, what of it has been read, and what not.  A change of hash forgets all."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, starts, ends = state.get if state.exists else (None, [], [])
        have = list(zip(starts, ends, strict=True))
        for rows in batches:
            out = []
            for r in rows.sort_values("seq").itertuples():
                if r.hash != known:
                    known, have = r.hash, []
                seen = any(a <= r.a and r.b <= b for a, b in have)
                have = merged([*have, (int(r.a), int(r.b))])
                left = [(x + 1, y - 1) for x, y in zip([0, *(b for _, b in have)], [*(a for a, _ in have), int(r.total) + 1], strict=True) if y - x > 1]
                out.append((key[0], r.seq, seen, said(have), said(left)))
            yield pd.DataFrame(out, columns=["path", "seq", "seen", "read", "unread"])
        state.update((known, [a for a, _ in have], [b for _, b in have]))

    return reads.groupBy("path").applyInPandasWithState(follow, "path string, seq long, seen boolean, read string, unread string", "hash long, a array<long>, b array<long>", "append", GroupStateTimeout.NoTimeout)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def said(spans: list[tuple[int, int]]) -> str:
    return ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in spans)


# --- incremental indexing ------------------------------------------------------------------


def new_contents(batch: DataFrame, claimed: DataFrame) -> DataFrame:
    """path, text of a batch whose content isn't what the path was last indexed with; the last by seq of each path."""
    last = batch.groupBy("path").agg(F.max_by(F.struct("seq", "text"), "seq").alias("r")).select("path", "r.seq", "r.text", X.content_hash(F.col("r.text")).alias("hash"))
    return last.join(latest(claimed).select("path", "hash"), ["path", "hash"], "left_anti")


def stream_upsert(source: DataFrame, table: str, checkpoint: str, index: Callable[[DataFrame], None] = lambda rows: None):
    """Starts a query that indexes new contents of (path, seq, text) and records them under `table`.

    A batch is recorded after it was indexed, so one that fails is taken again; records carry the batch's number,
    and a batch that is repeated replaces its own records.
    """
    schema = "path string, hash long, seq long, text string, batch long"

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(table)
        claimed = spark.read.schema(schema).parquet(table).where(F.col("batch") != number)
        fresh = new_contents(batch, claimed).persist()
        index(fresh)
        fresh.withColumn("batch", F.lit(number).cast("long")).select("path", "hash", "seq", "text", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)
        fresh.unpersist()

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame) -> DataFrame:
    """The current content of each path."""
    return table.groupBy("path").agg(F.max_by(F.struct("hash", "text"), F.struct("batch", "seq")).alias("r")).select("path", "r.hash", "r.text")


class Progress(StreamingQueryListener):
    """Counts of a running index: phase, batches and rows done."""

    def __init__(self):
        self.phase, self.batches, self.rows, self.message = "idle", 0, 0, ""

    def onQueryStarted(self, event) -> None:
        self.phase = "running"

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        self.phase = "idle"

    def onQueryTerminated(self, event) -> None:
        self.phase, self.message = ("failed", event.exception) if event.exception else ("done", "")
