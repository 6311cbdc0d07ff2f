"""Queries against their SQL on rows with nulls, and on values beyond those of the smallest tables."""

import random

import duckdb
import numpy as np
import pytest

from test_entry import table
from tessera.operators import intervals, neighbour_graph, planner, vector
from tessera.plans import catalog


def same(spark, folder, name, *views):
    c = duckdb.connect()
    for v in views:
        c.execute(f"create view {v} as select * from '{folder}/{v}.parquet/*.parquet'")
    df, out = catalog.QUERIES[name](spark, str(folder)), c.sql(catalog.ORACLES[name])
    return table(df.columns, [tuple(r) for r in df.collect()]) == table(out.columns, out.fetchall())


@pytest.mark.parametrize("name", ["interval_merge", "interval_gaps", "interval_coverage", "interval_cover"])
def test_intervals_with_nulls_equal_sql(spark, tmp_path, name):
    rng = random.Random(5)

    def some(most, share):
        return None if rng.random() < share else rng.randrange(1, most)

    rows = {(some(60, 0.1), some(4000, 0.2), some(8, 0.2)) for _ in range(1500)} | {(70, 9, None), (71, None, 3), (72, None, None)}
    spans = {(k, a, None if a is None or n is None else a + n): (k, a, n) for k, a, n in rows}  # SQL leaves the order of equal intervals open
    spark.createDataFrame(list(spans.values()), "l_suppkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(some(4000, 0.1),) for _ in range(500)], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert same(spark, tmp_path, name, "lineitem", "orders")


def test_sizes_stay_in_megabytes(spark, tmp_path):
    keys = [0, 1, 256, 257, 1051, 1052, 262144, 786432, 1076973, 1076974, 1310720, 8000000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert same(spark, tmp_path, "effort_and_size", "part")


def test_launch_plans_are_not_sorted(spark):
    models = spark.range(100).selectExpr("id as model_id", "6512 as file_mib", "32 as layers", "id * 100 as free_mib", "-1 as requested_ngl", "0 as max_ctx")
    plan = planner.plan_launch(models.unionByName(models))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Window" not in plan and "Sort" not in plan
    assert planner.plan_launch(models.unionByName(models)).count() == 100


def test_covers_join_nothing(spark):
    rows = [("k", 1, 4), ("k", 9, 20), (None, 1, 9), ("m", 3, 3)]
    asked = [("k", 1, 4), ("k", 2, 5), ("k", 9, 20), ("k", 9, 20), (None, 1, 2), ("m", 3, 3), ("m", None, 3), ("n", 1, 1)]
    have, wanted = (spark.createDataFrame(x, "key string, a long, b long") for x in (rows, asked))
    out = intervals.covers(have, wanted)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {(*x, x in {("k", 1, 4), ("k", 9, 20), ("m", 3, 3)}) for x in asked} and out.count() == len(set(asked))


def test_nearest_in_bounded_tiles(spark, monkeypatch):
    x = np.random.default_rng(2).integers(-2, 3, (3000, 4)).astype(float)  # many ties
    plain, most = vector.cosines, getattr(vector, "ROWS", 1024) * getattr(vector, "ASKED", 512)

    def bounded(a, b):
        assert len(a) * len(b) <= most
        return plain(a, b)

    monkeypatch.setattr(vector, "cosines", bounded)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>").repartition(1)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["cos"]) for r in vector.knn(chunks.where("chunk_id < 700").withColumnRenamed("chunk_id", "query_id"), chunks, 15).collect()}
    cos = np.round(plain(x[:700], x), 6) + 0.0
    for q in range(700):
        order = np.lexsort((np.arange(3000), -cos[q]))[:15]
        assert [got[q, n + 1] for n in range(15)] == [(i, cos[q, i]) for i in order]


def test_graph_rounds_broadcast_no_table(spark):
    table = spark.createDataFrame([(i, b"ab", [i + 1], [0.5], [True]) for i in range(50)], "id bigint, code binary, ids array<bigint>, sims array<float>, fresh array<boolean>")
    assert "BroadcastExchange" not in neighbour_graph.meet(table, 4, 0)._jdf.queryExecution().executedPlan().toString()
    nodes = spark.range(5000).selectExpr("id", "cast(cast(id as string) as binary) as code")
    by_hash = [bytes(r["code"]) for r in nodes.selectExpr("*", "xxhash64(id, 3) as h").orderBy("h", "id").collect()]
    for n in (5000, 100000):  # more nodes announced than there are: too few keep to the bound
        assert [bytes(c) for c in neighbour_graph.first_by_hash(nodes, n, 3, 40)] == by_hash[:40]
