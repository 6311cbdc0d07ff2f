"""An approximate index: a graph of near neighbours in layers, built by NN-descent and searched by beams.

A node's level is geometric (a hash of its id decides), and layer l holds the nodes of level l or more, so layers
shrink by the factor `m` until one is small enough to be compared as a whole.  In each layer a node has a bounded list
of its `k` nearest.  NN-descent makes the lists: they start from exact comparisons within overlapping cells around
sampled centres, a few times over; then, in rounds, every node brings its neighbours and some of those that name it
together, and each pair of them that has not met is compared.  It ends when few entries change in a round.

A round is a join of edges with nodes, a grouping by node and a merge of lists; vectors travel as 8-bit codes.  What
one group holds is bounded (k neighbours, as many reverse ones, a cell of at most CELL codes and the chance spread of
its split), so a hub or a vector that a third of all rows share makes no large task; only the joins with nodes meet
a hub's rows, and Spark splits those.  A search sends all queries through each step together.

The centres (at most CENTRES codes) and the top layer (at most about TOP codes) are all that is broadcast: joins are merged
by hint, as a broadcast takes one side through the driver, in every round anew.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, delete, release
from .vector import similarity

CELL, CENTRES, TOP = 1500, 4096, 2048
#: Cells that a vector is in, and times that cells are made anew.
NEAR, PASSES = 4, 3
#: Partners that a member of a neighbourhood is told of in a round.
TOLD = 8
LISTS = "id bigint, code binary, ids array<bigint>, sims array<float>, fresh array<boolean>"


def level(key: Column, m: int) -> Column:
    """floor(-log_m(u)), u in (0, 1] from the SHA-256 of the id."""
    u = (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 13), 16, 10).cast("double") + 1) / F.lit(2.0**52)
    return F.floor(-F.log(u) / math.log(m)).cast("int")


def sound(vector: str, dim: int) -> Column:
    """Of `dim` components, all of them finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def encode(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """Adds code: the vector's components as signed bytes of its greatest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            codes = np.rint(127 * x / np.abs(x).max(1, initial=1e-300, keepdims=True)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "code"])

    at = rows.columns.index(vector)
    return rows.mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", code binary")


def decode(column: pa.Array) -> np.ndarray:
    """Codes as unit vectors of 32-bit numbers."""
    n = len(column)
    raw = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(n, -1).astype(np.float32) if n else np.zeros((0, 1), np.float32)
    return raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def flat(column: pa.Array, kind=None) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    return values if kind is None else values.astype(kind), np.repeat(np.arange(len(column)), size)


def best(row: np.ndarray, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray, k: int) -> np.ndarray:
    """Which entries are a row's k most similar, each id once (an old entry rather than a fresh one), in order."""
    order = np.lexsort((fresh, ids, row))
    first = np.ones(len(order), bool)
    first[1:] = (row[order][1:] != row[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[first]
    order = order[np.lexsort((ids[order], -sims[order], row[order]))]
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    return order[place < k]


def merge(parts: DataFrame, k: int) -> DataFrame:
    """Rows of (id, code or null, ids, sims, fresh) -> one row an id with its k best entries; ids without a code go."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = flat(batch.column(2))
            sims, fresh = flat(batch.column(3))[0], flat(batch.column(4), bool)[0]
            other = ids != np.asarray(batch.column(0))[row]
            ids, row, sims, fresh = ids[other], row[other], sims[other], fresh[other]
            pick = best(row, ids, sims, fresh, k)
            at = pa.array(np.searchsorted(row[pick], np.arange(batch.num_rows + 1)), pa.int32())
            out = [pa.ListArray.from_arrays(at, pa.array(x[pick])) for x in (ids, sims, fresh)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], ["id", "code", "ids", "sims", "fresh"])

    whole = parts.groupBy("id").agg(F.max("code").alias("code"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "sims", "fresh")))
    return whole.where("code is not null").mapInArrow(work, LISTS)


def first_by_hash(nodes: DataFrame, n: int, turn: int, count: int) -> list[bytes]:
    """The codes of the `count` nodes that come first by a hash of the id.

    Tasks send only nodes below a bound that about twice as many nodes keep to; not each of them `count` nodes.
    """
    chance, some = F.xxhash64("id", F.lit(turn)), nodes
    if n > 2 * count + 64:
        bound = -(1 << 63) + (1 << 64) * (2 * count + 64) // n
        some = nodes.where(chance < F.lit(bound))

    def first(rows: DataFrame) -> list[bytes]:
        return [r[0] for r in rows.orderBy(chance, "id").limit(count).select("code").collect()]

    found = first(some)
    return found if len(found) == min(count, n) else first(nodes)


def in_cells(nodes: DataFrame, n: int, turn: int, k: int) -> DataFrame:
    """Rows of (id, null, ids, sims, fresh): the nearest of each node in its cells, exact as far as codes go."""
    count = min(CENTRES, max(1, -(-n * NEAR // CELL)))
    near = min(NEAR, count)
    if n <= CELL:
        count = near = 1
    centres = decode(pa.array(first_by_hash(nodes, n, turn, count), pa.binary()))

    def cells(batches: Iterator[pa.RecordBatch], splits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = decode(batch.column(1))
            cell = np.argpartition(-(x @ centres.T), near - 1, axis=1)[:, :near].astype(np.int64) if near < count else np.tile(np.arange(count), (len(x), 1))
            if splits is not None:  # a cell too large for one task is cut up by chance
                chance = np.asarray(batch.column(2)).astype(np.uint64) >> np.uint64(11)
                cell = (cell << 32) + (chance[:, None] % splits[cell]).astype(np.int64)
            take = pa.array(np.repeat(np.arange(len(x)), near))
            yield pa.RecordBatch.from_arrays([pa.array(cell.reshape(-1)), batch.column(0).take(take), batch.column(1).take(take)], ["cell", "id", "code"])

    schema = "cell bigint, id bigint, code binary"
    rows = nodes.select("id", "code", F.xxhash64("id", F.lit(turn + 77)).alias("chance"))
    splits = np.ones(count, np.uint64)
    for r in rows.mapInArrow(cells, schema).groupBy("cell").count().collect():
        splits[r["cell"]] = -(-r["count"] // (CELL + CELL // 3))

    def compare(cell: pa.Table) -> pa.Table:
        x, ids = decode(cell.column("code").combine_chunks()), np.asarray(cell.column("id"))
        out_ids, out_sims = [], []
        for lo in range(0, len(x), 512):
            sims = x[lo : lo + 512] @ x.T
            some = np.arange(min(512, len(x) - lo))
            sims[some, lo + some] = -2
            most = min(k, len(x) - 1)
            top = np.argpartition(-sims, most - 1, axis=1)[:, :most] if most else np.zeros((len(some), 0), int)
            out_ids += list(ids[top])
            out_sims += list(np.take_along_axis(sims, top, 1))
        fresh = [np.ones(len(v), bool) for v in out_ids]
        return pa.Table.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.binary()), lists(out_ids, pa.int64()), lists(out_sims, pa.float32()), lists(fresh, pa.bool_())], ["id", "code", "ids", "sims", "fresh"])

    dealt = rows.mapInArrow(lambda batches: cells(batches, splits), schema)
    return dealt.groupBy("cell").applyInArrow(compare, LISTS)


def meet(table: DataFrame, k: int, turn: int) -> DataFrame:
    """Rows of (id, null, ids, sims, fresh): what members of a neighbourhood learn of each other in one round."""
    worst = F.when(F.size("ids") == k, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("float")
    edges = table.select("id", "code", worst.alias("worst"), F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("id", "code", "worst", F.col("e.ids").alias("to"), F.col("e.fresh").alias("fresh"))
    # of those that name a node, at most k, fresh ones first
    order = Window.partitionBy("pivot").orderBy(F.desc("fresh"), F.xxhash64("member", F.lit(turn)), "member")
    back = edges.select(F.col("to").alias("pivot"), F.col("id").alias("member"), "code", "worst", "fresh").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")
    known = table.select(F.col("id").alias("member"), "code", worst.alias("worst"))
    out = edges.select(F.col("id").alias("pivot"), F.col("to").alias("member"), "fresh").join(known.hint("merge"), "member").select("pivot", "member", "code", "worst", "fresh")
    whole = out.unionByName(back).groupBy("pivot").agg(F.collect_list(F.struct("member", "code", "worst", "fresh")).alias("met"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                met = batch.column(0).slice(lo, 256)
                size = np.diff(met.offsets.to_numpy())
                inner = met.flatten()
                codes = decode(inner.field("code"))
                row = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                shape = (len(size), int(size.max(initial=0)))
                x = np.zeros((*shape, codes.shape[1]), np.float32)
                ids, least, fresh = np.full(shape, -1, np.int64), np.full(shape, 9, np.float32), np.zeros(shape, bool)
                there = np.zeros(shape, bool)
                x[row, place], there[row, place] = codes, True
                ids[row, place], least[row, place], fresh[row, place] = (np.asarray(inner.field(c)) for c in ("member", "worst", "fresh"))
                sims = x @ x.transpose(0, 2, 1)
                ok = there[:, :, None] & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (ids[:, :, None] != ids[:, None, :])
                sims[~ok | (sims <= least[:, :, None])] = -3
                most = min(TOLD, shape[1])
                top = np.argpartition(-sims, most - 1, axis=2)[:, :, :most]
                got = np.take_along_axis(sims, top, 2)
                good = got > -3
                p, a = np.nonzero(good.any(2))
                count = good[p, a].sum(1)
                at = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                to = ids[p[:, None], top[p, a]][good[p, a]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[p, a]), pa.nulls(len(p), pa.binary()), pa.ListArray.from_arrays(at, pa.array(to)), pa.ListArray.from_arrays(at, pa.array(got[p, a][good[p, a]], pa.float32())),
                    pa.ListArray.from_arrays(at, pa.array(np.ones(len(to), bool))),
                ], ["id", "code", "ids", "sims", "fresh"])

    return whole.select("met").mapInArrow(work, LISTS)


def descend(nodes: DataFrame, k: int, rounds: int = 6, least: float = 0.02) -> DataFrame:
    """nodes (id, code) -> a written table of LISTS; ends after a round in which a share below `least` of the entries is new."""
    n, table = nodes.count(), None
    own = nodes.select("id", "code", F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<float>").alias("sims"), F.array().cast("array<boolean>").alias("fresh"))
    for turn in range(PASSES if n > CELL else 1):
        old, table = table, cut(merge(in_cells(nodes, n, turn, k).unionByName(own if table is None else table), k), "neighbours")
        if old is not None:
            release(old)
    for turn in range(rounds if n > CELL else 0):  # one cell has compared all with all
        stale = table.withColumn("fresh", F.transform("ids", lambda _: F.lit(False)))
        old, table = table, cut(merge(meet(table, k, turn).unionByName(stale), k), "neighbours")
        release(old)
        new, every = table.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("ids"))).first()
        if (new or 0) < least * max(every or 0, 1):
            break
    return table


class NeighbourGraph:
    """nodes: id, level, vector, code.  edges: layer, node, neighbours (nearest first).  stats: a dict for each layer."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, stats: list[dict], dim: int, k: int):
        self.nodes, self.edges, self.stats, self.dim, self.k = nodes, edges, stats, dim, k

    @classmethod
    def build(cls, vectors: DataFrame, path: str, k: int = 32, m: int = 32, key: str = "vec_id", vector: str = "embedding") -> NeighbourGraph:
        """Builds the graph of all vectors of the commonest length into the folder `path`, which must be new.

        Null vectors, vectors of another length, zero or non-finite ones and null ids are in no search's result; of rows that
        share an id the one with the smallest vector is taken.
        """
        spark = vectors.sparkSession
        sizes = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = sizes["d"] if sizes else 0
        good = vectors.where(sound(vector, dim) & F.col(key).isNotNull())
        rows = good.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.col(vector).cast("array<float>")).alias("vector")).withColumn("level", level(F.col("id"), m))
        encode(rows.select("id", "level", "vector"), "vector", max(dim, 1)).write.parquet(f"{path}/nodes")
        nodes = spark.read.parquet(f"{path}/nodes")
        per_level = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}
        layer, tables = 0, []
        while (size := sum(c for lv, c in per_level.items() if lv >= layer)) > (TOP if layer else k + 1):
            table = descend(nodes.where(F.col("level") >= layer).select("id", "code"), k)
            tables.append((layer, size, table))
            layer += 1
        stats = []
        for at, size, table in tables:
            # clustered by node, so that a look-up of some nodes reads the row groups that hold them
            out = table.select(F.lit(at).alias("layer"), F.col("id").alias("node"), F.col("ids").alias("neighbours"))
            out.repartitionByRange("node").sortWithinPartitions("node").write.mode("append").parquet(f"{path}/edges")
            low, high, total = out.agg(F.min(F.size("neighbours")), F.max(F.size("neighbours")), F.sum(F.size("neighbours"))).first()
            stats.append({"layer": at, "nodes": size, "edges": total, "least_degree": low, "most_degree": high})
            release(table)
        stats.append({"layer": layer, "nodes": sum(c for lv, c in per_level.items() if lv >= layer), "edges": 0, "least_degree": 0, "most_degree": 0})
        about = json.dumps({"dim": dim, "k": k, "stats": stats})
        spark.createDataFrame([(about,)], "about string").write.parquet(f"{path}/about")  # last: a graph without it isn't finished
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighbourGraph:
        """The graph below `path`; an error where its build wasn't finished."""
        about = json.loads(spark.read.schema("about string").parquet(f"{path}/about").first()[0])
        edges = "layer int, node bigint, neighbours array<bigint>"
        flat_ = len(about["stats"]) == 1  # too few nodes for a layer with edges
        return cls(spark.read.parquet(f"{path}/nodes"), spark.createDataFrame([], edges) if flat_ else spark.read.schema(edges).parquet(f"{path}/edges"), about["stats"], about["dim"], about["k"])

    def statistics(self) -> DataFrame:
        """layer, nodes, edges, least_degree, most_degree: from what was written with the graph, without a look at it."""
        rows = [tuple(int(s[c] or 0) for c in ("layer", "nodes", "edges", "least_degree", "most_degree")) for s in self.stats]
        return self.nodes.sparkSession.createDataFrame(rows, "layer int, nodes long, edges long, least_degree long, most_degree long")

    def exact(self, found: DataFrame, queries: DataFrame, k: int, *more: str) -> DataFrame:
        """query_id, id (and more columns) -> query_id, chunk_id, cos, rank by the vectors themselves, ties by id."""
        rows = found.join(self.nodes.select("id", "vector").hint("merge"), "id").join(queries.select("query_id", F.col("vector").alias("asked")).hint("merge"), "query_id")
        scored = rows.select("query_id", F.col("id").alias("chunk_id"), F.round(similarity(F.col("asked"), F.col("vector")), 6).alias("cos"), *more)
        order = Window.partitionBy("query_id").orderBy(F.desc("cos"), "chunk_id")
        return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

    def neighbours_of(self, ids: DataFrame, k: int) -> DataFrame:
        """query_id, chunk_id, cos, rank: the k nearest in the lists of the given nodes (id), themselves left out."""
        mine = self.nodes.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "vector")
        if len(self.stats) == 1:  # all nodes are in the top layer, which is compared as a whole
            found = mine.join(F.broadcast(self.nodes.select("id")), F.col("id") != F.col("query_id")).select("query_id", "id")  # k + 1 nodes at most
        else:
            found = self.edges.where("layer = 0").join(mine.select(F.col("query_id").alias("node")), "node", "left_semi").select(F.col("node").alias("query_id"), F.explode("neighbours").alias("id"))
        return self.exact(found, mine, k)

    def search(self, queries: DataFrame, k: int, beam: int = 48, width: int = 24, rounds: int = 24) -> DataFrame:
        """queries (query_id, vector) -> query_id, chunk_id, cos, rank, visited (vectors compared for that query).

        A beam holds the `beam` best nodes met so far, or `width` above the lowest layer.  In a round the first `width` of a
        beam that weren't opened yet are, and neighbours not met before are compared; a layer ends when no beam has such a
        node, or after `rounds`.  The beam's nodes are then ranked by their vectors.  Queries with a null, zero or odd vector
        find nothing.
        """
        asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).where(sound("vector", self.dim))
        spark, state = queries.sparkSession, None
        top = self.nodes.where(F.col("level") >= self.stats[-1]["layer"]).select("id", "code").orderBy("id").collect()
        names, codes = np.array([r["id"] for r in top], np.int64), decode(pa.array([r["code"] for r in top], pa.binary()))
        kind = queries.schema["query_id"].dataType.simpleString()
        schema = f"query_id {kind}, code binary, ids array<bigint>, sims array<float>, opened array<boolean>, seen array<bigint>"
        fields = schema.split(", ")

        def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index
                sims = decode(batch.column(at("code"))) @ codes.T if len(names) else np.zeros((batch.num_rows, 0), np.float32)
                order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
                shut = [np.zeros(order.shape[1], bool)] * len(sims)
                yield pa.RecordBatch.from_arrays([
                    batch.column(at("query_id")), batch.column(at("code")), lists(list(names[order]), pa.int64()), lists(list(np.take_along_axis(sims, order, 1)), pa.float32()),
                    lists(shut, pa.bool_()), lists([names] * len(sims), pa.int64()),
                ], [f.split()[0] for f in fields])

        def step(batches: Iterator[pa.RecordBatch], beam: int) -> Iterator[pa.RecordBatch]:
            """A beam that has opened its first ones, with the codes of what they led to."""
            for batch in batches:
                c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                ids, row = flat(c["ids"])
                sims, opened = flat(c["sims"])[0], flat(c["opened"], bool)[0] | flat(c["now"], bool)[0]
                new = c["found"].flatten()
                into = flat(c["found"])[1]
                asked_codes, to = decode(c["code"]), np.asarray(new.field("id"), np.int64)
                got = (decode(new.field("code")) * asked_codes[into]).sum(1) if len(to) else np.zeros(0, np.float32)
                row, ids, sims, opened = np.concatenate([row, into]), np.concatenate([ids, to]), np.concatenate([sims, got.astype(np.float32)]), np.concatenate([opened, np.zeros(len(to), bool)])
                pick = best(row, ids, sims, ~opened, beam)
                at = pa.array(np.searchsorted(row[pick], np.arange(batch.num_rows + 1)), pa.int32())
                seen, sr = flat(c["seen"])
                order = np.argsort(np.concatenate([sr, into]), kind="stable")
                met = pa.ListArray.from_arrays(pa.array(np.searchsorted(np.concatenate([sr, into])[order], np.arange(batch.num_rows + 1)), pa.int32()), pa.array(np.concatenate([seen, to])[order], pa.int64()))
                yield pa.RecordBatch.from_arrays([c["query_id"], c["code"], *(pa.ListArray.from_arrays(at, pa.array(x[pick])) for x in (ids, sims, opened)), met], [f.split()[0] for f in fields])

        beam = max(beam, k)
        state = cut(encode(asked, "vector", max(self.dim, 1)).mapInArrow(enter, schema), "beams")
        for layer in range(len(self.stats) - 2, -1, -1):
            state, old = cut(state.withColumn("opened", F.transform("ids", lambda _: F.lit(False))), "beams"), state
            release(old)
            held = width if layer else beam
            adjacent = self.edges.where(F.col("layer") == layer).select("node", "neighbours")
            for _ in range(rounds):
                # the first `width` that are shut, by their place in the beam
                shut = F.slice(F.filter(F.transform("opened", lambda o, i: F.when(~o, i)), lambda i: i.isNotNull()), 1, width)
                at = state.withColumn("_turn", shut).withColumn("now", F.transform("ids", lambda _, i: F.array_contains("_turn", i))).drop("_turn")
                open_ = at.where(F.exists("now", lambda x: x))
                front = open_.select("query_id", F.explode(F.transform(F.filter(F.arrays_zip("ids", "now"), lambda z: z["now"]), lambda z: z["ids"])).alias("node"))
                led = front.join(adjacent.hint("merge"), "node").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("led"))
                new = led.join(state.select("query_id", "seen").hint("merge"), "query_id").select("query_id", F.explode(F.array_except("led", "seen")).alias("id"))
                found = new.join(self.nodes.select("id", "code").hint("merge"), "id").groupBy("query_id").agg(F.collect_list(F.struct("id", "code")).alias("found"))
                empty = F.array().cast("array<struct<id:bigint,code:binary>>")
                joined = at.join(found.hint("merge"), "query_id", "left").withColumn("found", F.coalesce("found", empty))
                state, old = cut(joined.mapInArrow(lambda batches, held=held: step(batches, held), schema), "beams"), state
                release(old)
                if not state.where(F.exists("opened", lambda o: ~o)).limit(1).count():
                    break
        found = state.select("query_id", F.size("seen").cast("long").alias("visited"), F.explode("ids").alias("id"))
        return self.exact(found, asked, k, "visited")

    def drop(self, path: str) -> None:
        delete(self.nodes.sparkSession, path)
