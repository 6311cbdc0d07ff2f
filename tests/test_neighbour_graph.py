"""The graph index against exact search, its statistics against DuckDB, and rows that have no place in it."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbour_graph as ng
from tessera.operators import vector
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, id int, code string, layer int"


def rows_of(n, dim=24):
    """Random vectors, one of them many times, and rows that can't be indexed."""
    x = np.random.default_rng(7).normal(size=(n, dim)).astype(np.float32)
    x[n - 60 :] = x[5]
    odd = [(None, x[1].tolist()), (n, None), (n + 1, []), (n + 2, [1.0]), (n + 3, [0.0] * dim), (n + 4, [float("nan")] * dim), (n + 5, [None] + [1.0] * (dim - 1)), (3, [9.0] * dim)]
    return [(i, v.tolist(), 1, "clash", 2) for i, v in enumerate(x)] + [(*r, 1, "clash", 2) for r in odd]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = rows_of(2400)
    path = f"file://{tmp_path_factory.mktemp('graph')}/g"
    graph = ng.NeighbourGraph.build(spark.createDataFrame(rows, SCHEMA).repartition(3), path, k=24)
    x = {i: v for i, v, *_ in reversed(rows[:2400])}
    return graph, path, x


def recall(got, want):
    return sum(len(want[q] & got.get(q, set())) for q in want) / sum(map(len, want.values()))


def exact(x, ids, k, others):
    names = np.array(sorted(x))
    m = np.array([x[i] for i in names])
    cos = vector.cosines(np.array([x[i] for i in ids]), m)
    out = {}
    for q, row in zip(ids, cos, strict=True):
        order = [i for i in names[np.lexsort((names, -np.round(row, 6)))] if not others or i != q]
        out[q] = {int(i) for i in order[:k]}
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], set()).add(r["chunk_id"])
    return out


def test_lists_and_beams_find_what_exact_search_finds(spark, built):
    graph, _, x = built
    ids = [i for i in range(0, 2300, 20)]
    near = graph.neighbours_of(spark.createDataFrame([(i,) for i in ids], "id long"), 10)
    assert recall(found(near), exact(x, ids, 10, True)) >= 0.9
    asked = spark.createDataFrame([(i, x[i]) for i in ids] + [(-1, None), (-2, [1.0]), (-3, [0.0] * 24)], "query_id long, vector array<float>")
    got = graph.search(asked, 10, beam=32).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], set()).add(r["chunk_id"])
    assert set(by_query) == set(ids) and recall(by_query, exact(x, ids, 10, False)) >= 0.9
    assert np.mean([r["visited"] for r in got]) < 0.6 * 2400  # in so few dimensions and rows; the share falls as rows grow
    for r in got:  # what is found carries the exact cosine
        assert r["cos"] == pytest.approx(float(vector.cosines(np.array([x[r["query_id"]]]), np.array([x[r["chunk_id"]]]))[0, 0]), abs=2e-6)
    assert [r["rank"] for r in sorted(got, key=lambda r: (r["query_id"], -r["cos"], r["chunk_id"]))] == [*range(1, 11)] * len(ids)


def test_saved_graph_and_its_statistics(spark, built, tmp_path):
    graph, path, x = built
    again = ng.NeighbourGraph.load(spark, path)
    edges = duckdb.sql(f"select layer, count(*) as nodes, sum(len(neighbours)) as edges, min(len(neighbours)), max(len(neighbours)) from '{path[7:]}/edges/*.parquet' group by layer order by layer").fetchall()
    stats = [tuple(r) for r in again.statistics().orderBy("layer").collect()]
    assert stats[: len(edges)] == edges and stats[-1][1] <= ng.TOP and stats[0][1] == 2400
    assert again.nodes.count() == 2400 and again.nodes.where("id = 3").first()["vector"] == min(x[3], [9.0] * 24)
    lists = {(r["layer"], r["node"]): r["neighbours"] for r in again.edges.collect()}
    assert all(len(set(v)) == len(v) <= 24 and node not in v for (_, node), v in lists.items())
    with pytest.raises(Exception, match="about"):  # a build that didn't end is no graph
        ng.NeighbourGraph.load(spark, str(tmp_path / "none"))


def test_small_tables(spark, tmp_path):
    for i, n in enumerate((0, 1, 5)):
        graph = ng.NeighbourGraph.build(spark.createDataFrame([(j, [1.0, float(j)], 1, "", 2) for j in range(n)], SCHEMA), f"file://{tmp_path}/{i}")
        near = sorted(tuple(r) for r in graph.neighbours_of(spark.createDataFrame([(0,)], "id long"), 2).select("query_id", "chunk_id", "rank").collect())
        assert near == [(0, 1, 1), (0, 2, 2)][: max(0, n - 1)]
        got = graph.search(spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<float>"), 3).collect()
        assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"])] == [*range(min(n, 3))]


def test_entries_are_merged_once_each(spark):
    schema = ng.LISTS
    parts = [(1, b"c", [2, 3], [0.5, 0.4], [False, False]), (1, None, [2, 1, 4], [0.6, 1.0, 0.45], [True, True, True]), (9, None, [1], [0.1], [True])]
    got = ng.merge(spark.createDataFrame(parts, schema), 2).collect()
    assert [(r["id"], r["ids"], [round(s, 2) for s in r["sims"]], r["fresh"]) for r in got] == [(1, [2, 4], [0.5, 0.45], [False, True])]


@pytest.mark.parametrize("name", ["graph_knn", "graph_beam_search"])
def test_registered_queries_have_recall(spark, name):
    x = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = [i for i in sorted(x) if i % 20 == 0]
    got = found(catalog.QUERIES[name](spark, SF))
    assert set(got) == set(ids) and recall(got, exact(x, ids, 10, name == "graph_knn")) >= 0.9
