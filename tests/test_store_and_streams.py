"""Files, the store, and streams."""

import struct

import pytest
from pyspark.sql import functions as F

from tessera.session import RetrievalOptions
from tessera.sources import files as S
from tessera.sources.store import ChunkStore
from tessera.streaming import events as E


@pytest.fixture
def tree(tmp_path):
    for name, content in (("main.rs", "fn main() {}\n"), ("src/notes.md", "some prose here\n"), ("node_modules/x.js", "no"), ("target/y.rs", "no"), (".git2/z.rs", "no"), ("big.txt", "x" * (1 << 20) + "y"), ("bin.txt", "a\0b"), ("sub/Build/k.py", "z = 1\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    return tmp_path


def test_walks_and_admission(spark, tree):
    got = {r["name"]: r["status"] for r in S.path_index(spark, str(tree)).collect()}
    assert got == {"main.rs": "ok", "src/notes.md": "ok", "big.txt": "too large", "bin.txt": "binary", "sub/Build/k.py": "ok"}
    assert sorted(r["path"] for r in S.workspace_walk(spark, str(tree)).collect()) == ["big.txt", "bin.txt", "main.rs", "src/notes.md"]
    with pytest.raises(ValueError):
        S.path_index(spark, str(tree), most_files=3)
    listing = S.list_dir(S.entries_of(S.read_tree(spark, str(tree))))
    assert [r["name"] for r in listing.collect()] == ["node_modules", "src", "sub", "target", "bin.txt", "main.rs", "big.txt"]  # lines sort by their size column first
    assert [r["name"] for r in S.browse(S.read_tree(spark, str(tree))).collect()] == ["node_modules", "src", "sub", "target"]


def test_guarded_writes(tmp_path):
    S.write_new(str(tmp_path), "a/b.txt", "x y x")
    for bad in ("../out", "a/b.txt"):
        with pytest.raises((PermissionError, FileExistsError)):
            S.write_new(str(tmp_path), bad, "z")
    with pytest.raises(ValueError):
        S.edit_file(str(tmp_path), "a/b.txt", "x", "q")
    assert S.edit_file(str(tmp_path), "a/b.txt", "y", "q") == 1 and S.edit_file(str(tmp_path), "a/b.txt", "x", "w", True) == 2
    assert (tmp_path / "a/b.txt").read_text() == "w q w"


def test_header_probe(spark):
    def text(s):
        return struct.pack("<Q", len(s)) + s.encode()

    head = b"GGUF" + struct.pack("<IQQ", 3, 0, 3) + text("a") + struct.pack("<I", 8) + text("v") + text("arr") + struct.pack("<IIQ", 9, 4, 2) + struct.pack("<II", 1, 2) + text("llama.block_count") + struct.pack("<II", 4, 32)
    assert S.block_count(head + b"\0" * 64) == 32 and S.block_count(head[:40]) is None and S.block_count(b"nope") is None
    got = S.block_counts(spark.createDataFrame([("m", bytearray(head)), ("n", bytearray(b"x"))], "path string, content binary")).collect()
    assert {r["path"]: r["blocks"] for r in got} == {"m": 32, "n": None}
    assert S.free_vram(spark.createDataFrame([("0, 700",), ("1, 7200",)], "line string")).first()[0] == 7200
    assert S.meminfo(spark.createDataFrame([("MemFree:   12 kB",)], "line string").select("line")).first()[:] == ("MemFree", 12)


def test_uploads_config_and_state(spark, tmp_path):
    up = S.uploaded(spark, '{"files": [{"name": "a.rs", "content": "x"}], "domain": "prose"}')
    assert up.first()["domain"] == "code" and S.uploadable(up).count() == 1
    (tmp_path / "c.toml").write_text("[rag]\nchunk_size = 7\nunknown = 1\n")
    assert RetrievalOptions.from_toml(str(tmp_path / "c.toml")) == RetrievalOptions(chunk_size=7) and S.config(str(tmp_path / "c.toml"))["rag"]["chunk_size"] == 7
    S.write_state(up, str(tmp_path / "s"))
    assert S.read_state(spark, str(tmp_path / "s"), "name string, domain string").first()[:] == ("a.rs", "code")


def embed(chunks):
    return chunks.withColumn("vector", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")))


def test_store(spark, tree, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/db")
    assert store.status()["chunks"] == 0
    out = store.index_path(str(tree), embed)
    assert out == {"files_indexed": 3, "skipped": 2, "chunks_indexed": 3, "code_total": 2, "text_total": 1}
    code = spark.createDataFrame([("main.rs", "l\n" * 70)], "name string, content string")
    assert store.index(code, embed) == {"chunks_indexed": 2, "domain_total": 3, "files": 1}
    s = store.status()
    assert (s["chunks"], s["chunks_code"], s["chunks_text"], s["vector_dim"], s["files"]) == (4, 3, 1, 2, 3)
    assert {"text_lc", "words"} <= set(store.chunks().columns)
    with pytest.raises(ValueError):
        store.index(code, lambda c: c.withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    store.clear("code")
    assert store.status()["chunks"] == 1
    store.clear("text")
    assert store.status()["chunks"] == 0 and not (tmp_path / "db").exists()


def test_chunked_bodies():
    assert E.decode_chunked(b"4\r\nWiki\r\n6;\r\n") == b"Wiki"
    assert E.decode_chunked(b"4\r\nWiki\r\n5\r\npedia\r\n0\r\n\r\n") == b"Wikipedia" and E.decode_chunked(b"") == b"" and E.decode_chunked(b"a\r\nshort") == b"short"


def test_fragments_fold(spark):
    rows = [(1, 1, 0, "id0", "grep", '{"pa'), (1, 2, 1, None, "read", "{"), (1, 3, 0, None, None, 'ttern"'), (1, 4, 0, "id9", None, ': "x"}'), (1, 5, 1, "z", None, "}")]
    f = spark.createDataFrame(rows, "stream long, seq long, index int, id string, name string, arguments string")
    assert sorted(tuple(r) for r in E.fold_fragments(f).collect()) == [(1, 0, "id9", "grep", '{"pattern": "x"}'), (1, 1, "z", "read", "{}")]


def run_stream(spark, df, schema, tmp_path, operator, mode):
    """Runs an operator over rows, one file a batch, and returns what it emitted."""
    for i, part in enumerate(df):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    seen = []
    operator(source).writeStream.outputMode(mode).foreachBatch(lambda b, n: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    return seen


def test_stateful_fold(spark, tmp_path):
    schema = "stream string, seq long, index int, id string, name string, arguments string"
    seen = run_stream(spark, [[("s", 1, 0, "i", "n", '{"a')], [("s", 2, 0, None, None, '": 1}')]], schema, tmp_path, E.stateful_calls, "update")
    assert max(seen, key=lambda r: len(r[4])) == ("s", 0, "i", "n", '{"a": 1}')


def test_frames_and_ledger(spark, tmp_path):
    seen = run_stream(spark, [[("s", 1, "data: a\n\nda")], [("s", 2, "ta: b\n\n")]], "stream string, seq long, piece string", tmp_path / "f", E.split_frames, "append")
    assert sorted(seen) == [("s", 0, "data: a"), ("s", 1, "data: b")]
    reads = [[("p", 1, 9, 100, 1, 40)], [("p", 2, 9, 100, 10, 20), ("p", 3, 9, 100, 41, 60)], [("p", 4, 8, 100, 1, 2)]]
    got = sorted(run_stream(spark, reads, "path string, seq long, hash long, total long, a long, b long", tmp_path / "l", E.read_ledger, "append"), key=lambda r: r[1])
    assert [r[2:] for r in got] == [(False, "1-40", "41-100"), (True, "1-40", "41-100"), (False, "1-60", "61-100"), (False, "1-2", "3-100")]


def test_stream_upsert(spark, tmp_path):
    schema = "path string, seq long, text string"
    for i, part in enumerate(([("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z"), ("b", 4, "y")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    indexed = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    E.stream_upsert(source, f"{tmp_path}/t", f"{tmp_path}/log", lambda rows: indexed.extend((r["path"], r["text"]) for r in rows.collect())).awaitTermination()
    assert sorted(indexed) == [("a", "x"), ("a", "z"), ("b", "y")]
    table = spark.read.schema("path string, hash long, seq long, text string, batch long").parquet(f"{tmp_path}/t")
    assert sorted((r["path"], r["text"]) for r in E.latest(table).collect()) == [("a", "z"), ("b", "y")]
