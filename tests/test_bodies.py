"""Chunked bodies as a stream: restarts in mid-chunk, ends, idle streams, late bytes and late fragments."""

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.streaming import bodies as B
from tessera.streaming import events as E


def chunked(data: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)) + b"0\r\n\r\n"


@given(st.binary(max_size=60), st.integers(1, 9), st.lists(st.integers(0, 200), max_size=6))
def test_decoder_is_the_same_however_bytes_are_cut(data, size, cuts):
    body = chunked(data, size)
    at = sorted({0, len(body), *(c for c in cuts if c < len(body))})
    decoder, lines = B.Decoder(), []
    for a, b in zip(at, at[1:], strict=False):
        decoder = B.Decoder(decoder.rest, decoder.left, decoder.head, decoder.over)  # as kept and restored
        lines += decoder.feed(body[a:b])
    want = E.decode_chunked(body).split(b"\n")
    want = want if want[-1] else want[:-1]
    assert decoder.over and lines == [w.removesuffix(b"\r").decode("utf-8", "replace") for w in want]


@pytest.fixture(scope="module")
def streaming(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    B.register(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers would keep availableNow from ending
    yield spark
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_restart_in_the_middle_of_a_chunk(streaming, tmp_path):
    folder, out = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    texts = {"a": "one\ntwo ünd drei\nthree\n" * 20, "b": "data: x\n\ndata: [DONE]\nbehind\n", "c": "never ended"}
    whole = {k: chunked(v.encode(), 7) for k, v in texts.items()}
    whole["c"] = whole["c"][:12]

    def run():  # every run is a restart from the checkpoint
        lines = B.body_lines(streaming.readStream.format("bodies").load(f"file://{folder}"))
        lines.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start(out).awaitTermination()

    for share in (0.37, 0.6, 1.0):
        for name, body in whole.items():
            (folder / name).write_bytes(body[: int(len(body) * share)])
        run()
    with open(folder / "b", "ab") as file:  # bytes behind the end of a body
        file.write(chunked(b"late\n", 3))
    run()
    got = sorted(tuple(r) for r in streaming.read.parquet(out).collect())
    want = [("a", i, x) for i, x in enumerate(texts["a"].split("\n")[:-1])] + [("b", 0, "data: x"), ("b", 1, ""), ("b", 2, "data: [DONE]")]
    assert got == want


def test_a_file_that_shrinks_is_an_error(streaming):
    with pytest.raises(ValueError, match="had 9 bytes and has 3"):
        B.BodyReader("file:///tmp").partitions({"x": 9}, {"x": 3})


SCHEMA = "stream string, seq long, index int, id string, name string, arguments string, done boolean"


def test_calls_end_with_done_and_late_fragments_are_left_out(streaming, tmp_path):
    steps = [
        [("s", 1, 0, "i", "n", '{"a', False), ("t", 1, 0, "j", "m", "x", False)],
        [("s", 3, 1, "k", "o", "[]", False), ("s", 2, 0, None, None, '": 1}', False)],
        [("s", 4, None, None, None, None, True), ("s", 5, 0, None, None, "behind", False)],
        [("s", 6, 0, "late", None, "late", False), ("t", 2, 0, None, None, "y", False)],
    ]
    for i, rows in enumerate(steps):  # every step is a restart
        streaming.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        calls = B.finished_calls(streaming.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
        calls.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        got = sorted(tuple(r) for r in streaming.read.schema("stream string, index int, id string, name string, arguments string").parquet(f"{tmp_path}/out").collect())
        assert got == ([("s", 0, "i", "n", '{"a": 1}'), ("s", 1, "k", "o", "[]")] if i >= 2 else [])


def test_idle_streams_end(streaming, tmp_path):
    streaming.createDataFrame([("t", 1, 0, "j", "m", "x", False)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    calls = B.finished_calls(streaming.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), idle=1000)
    streaming.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    query = calls.writeStream.format("memory").queryName("idle_calls").option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and not streaming.table("idle_calls").count():
            time.sleep(0.5)
        assert [tuple(r) for r in streaming.table("idle_calls").collect()] == [("t", 0, "j", "m", "x")]
    finally:
        query.stop()
