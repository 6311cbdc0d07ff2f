"""Contents that change back, and code that is indexed by its syntax."""

from pyspark.sql import functions as F

from tessera.sources.store import ChunkStore
from tessera.streaming import events as E


def test_a_content_that_comes_back_is_indexed_again(spark, tmp_path):
    schema = "path string, seq long, text string"
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    for seq, text in enumerate(["A", "B", "A", "A"]):
        spark.createDataFrame([("p", seq, text), ("q", seq, "same")], schema).coalesce(1).write.mode("append").parquet(source)
        E.stream_upsert(spark.readStream.schema(schema).parquet(source), table, f"{tmp_path}/log").awaitTermination()
        now = E.latest(spark.read.schema("path string, hash long, seq long, text string, batch long").parquet(table))
        assert {r["path"]: r["text"] for r in now.collect()} == {"p": text, "q": "same"}
    assert spark.read.parquet(table).groupBy("path").count().orderBy("path").collect() == [("p", 3), ("q", 1)]


def test_code_is_cut_by_its_syntax(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def vector(text):
        calls.add(1)
        return [float(len(text)), 1.0]

    body = "\n".join(f"    let x{i} = helper(x{i});" for i in range(30))
    code = f"use std::fmt;\n\npub fn one() {{\n{body}\n}}\n\npub struct Two {{\n    a: i32,\n    b: i32,\n}}\n"
    store = ChunkStore(spark, f"file://{tmp_path}/db")
    files = spark.createDataFrame([("a.rs", code), ("b.py", "z = 1\n")], "name string, content string")
    out = store.index(files, lambda c: c.withColumn("vector", vector("text")))
    sources = {r["source"] for r in store.read().collect()}
    assert any("one" in s for s in sources) and any("Two" in s for s in sources) and "a.rs:summary" in sources and "b.py:1-1" in sources
    assert out["chunks_indexed"] == len(sources) == calls.value and out["files"] == 2
