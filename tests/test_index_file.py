"""The binary index as a data source: round trips, files that are no index, and files that end too early."""

import glob
import struct

import pytest
from pyspark.sql import functions as F

from tessera.sources import index_file

ROWS = [("a.rs:1-2", "fn é() {}\n", "block", "a.rs", "code", [1.0, -2.5]), ("", "", "", "", "text", [0.0, 3.25]), ("c#0", "日本 😀", "file_summary", "c", "text", [1e-30, 7.0])]


def chunk(row):
    return b"".join(struct.pack("<I", len(x.encode())) + x.encode() for x in row[:5]) + struct.pack(f"<{len(row[5])}f", *row[5])


def whole(rows=ROWS, dim=2):
    return b"RAG3" + struct.pack("<II", len(rows), dim) + b"".join(map(chunk, rows))


GRAPH = struct.pack("<4I", 2, 1, 0, 16) + struct.pack("<I", 1) + struct.pack("<3I", 2, 1, 0) + struct.pack("<I", 0) + struct.pack("<I", 0) + struct.pack("<2I", 1, 0)


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    index_file.register(spark)


def read(spark, path, **options):
    return spark.read.format("chunk_index").options(**options).load(str(path))


def test_round_trip_in_the_format(spark, tmp_path):
    path = f"{tmp_path}/index"
    df = spark.createDataFrame(ROWS * 700, index_file.CHUNKS)
    df.repartition(3).withColumn("more", F.lit(1)).write.format("chunk_index").mode("append").save(path)
    assert read(spark, path).exceptAll(df).count() == 0 and read(spark, path).count() == 2100
    files = glob.glob(f"{path}/*")
    assert len(files) == 3 and all(f.split("/")[-1].startswith("part-") for f in files)
    assert sum(struct.unpack("<I", open(f, "rb").read(8)[4:])[0] for f in files) == 2100
    spark.createDataFrame(ROWS, index_file.CHUNKS).coalesce(1).write.format("chunk_index").mode("overwrite").save(path)
    assert read(spark, path).count() == 3
    only = next(f for f in glob.glob(f"{path}/*") if struct.unpack("<I", open(f, "rb").read(8)[4:])[0])
    assert open(only, "rb").read() == whole()  # byte for byte the format


def test_nulls_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(None, None, "k", None, None, None)], index_file.CHUNKS).coalesce(1).write.format("chunk_index").mode("append").save(f"{tmp_path}/n")
    assert [tuple(r) for r in read(spark, f"{tmp_path}/n").collect()] == [("", "", "k", "", "", [])]
    spark.createDataFrame([], index_file.CHUNKS).write.format("chunk_index").mode("append").save(f"{tmp_path}/e")
    assert read(spark, f"{tmp_path}/e").count() == 0


def test_what_is_no_index_is_empty(spark, tmp_path):
    assert read(spark, f"{tmp_path}/absent").count() == 0
    for name, data in (("old", b"RAG2" + whole()[4:]), ("short", b"RAG3"), ("none", b"")):
        (tmp_path / name).write_bytes(data)
        assert read(spark, tmp_path / name).count() == 0


@pytest.mark.parametrize("cut", [15, 30, len(whole()) - 1])
def test_truncated_is_an_error(spark, tmp_path, cut):
    (tmp_path / "t").write_bytes(whole()[:cut])
    with pytest.raises(Exception, match="truncated at chunk"):
        read(spark, tmp_path / "t").collect()


def test_graph_of_an_index(spark, tmp_path):
    (tmp_path / "g").write_bytes(whole() + GRAPH)
    assert read(spark, tmp_path / "g").count() == 3
    assert [tuple(r) for r in read(spark, tmp_path / "g", part="graph").orderBy("node", "layer").collect()] == [(0, 0, [1, 0]), (0, 1, []), (1, 0, [0])]
    (tmp_path / "h").write_bytes((whole() + GRAPH)[:-3])
    with pytest.raises(Exception, match="truncated at node 1"):
        read(spark, tmp_path / "h", part="graph").collect()
    (tmp_path / "i").write_bytes(whole())
    assert read(spark, tmp_path / "i", part="graph").count() == 0


def test_failed_job_leaves_nothing(spark, tmp_path):
    mixed = spark.createDataFrame([*ROWS, ("x", "", "", "", "", [1.0])], index_file.CHUNKS).coalesce(1)
    with pytest.raises(Exception, match="dimensions"):
        mixed.write.format("chunk_index").mode("append").save(f"{tmp_path}/f")
    assert read(spark, f"{tmp_path}/f").count() == 0 and not glob.glob(f"{tmp_path}/f/part-*")
