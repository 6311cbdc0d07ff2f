"""Near duplicates by an inverted join of signature coordinates (operator 10).

1. A document's set is its distinct word shingles; documents with equal sets (by a 128-bit sum over all
   shingles) form one class, represented by its least id, so exact copies cost one row each.
2. A class's signature has `COORDINATES` minima.  It is posted under (coordinate, value).  Two sets with
   Jaccard similarity s agree in each coordinate with probability s; pairs with fewer than `MATCHES`
   collisions aren't candidates (at s = 0.75 a pair is missed with probability 6e-7, the binomial tail).
3. Prefix and skip merging: pairs with `MATCHES` collisions must meet in the COORDINATES - MATCHES + 1
   rarest postings of either, in an order that is the same for all.  So a class is posted only there; values
   that nobody shares fill its prefix first, and the postings of frequent values are never merged.
4. Within a posting list every class is compared with the list's hub, the class that shares most of its
   signature with others (the centre of a group of edited copies, rather than one of its edges).  A hub has then met
   the whole list and leaves it; what it has linked is one component; lists with one component are done.  So a large
   group of copies costs about one comparison for each member and round, and nothing is cut short.
5. What two rounds leave apart is posted under its shingles, in the same manner: the rarest shared ones first, only
   so many as a pair at the similarity must meet in, and a pair counts only if enough shared shingles remain from
   there on (prefix and position bounds on full sets, both exact).  Hubs go over these lists too; then the members of
   a list's lesser components meet the whole list, as far as the bounds leave them.
6. Candidates' collisions are counted over the full signatures, then every one is confirmed on the full sets.
7. Components: tasks join a bounded number of links each, and alternating large-star and small-star steps
   join their results, in tables; nothing of this is collected.

Defined results: null and empty texts, and those without words, have an empty set and are linked with
nothing; fewer words than a shingle are one shingle; rows with one id are one document with several
texts; rows with a null id are kept, linked with nothing, and have no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import pack_text, tidy, unpack_text
from .common import LOWER, N1, Words, as_bytes, col, cut, in_doc, mix, release, seeded, slices

SHINGLE, PERCENT = 5, 75
COORDINATES, MATCHES = 40, 16
PREFIX = COORDINATES - MATCHES + 1
FLIP, TIMES, AGAIN = ((seeded(s, COORDINATES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1) for s in (11, 12, 13))


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in document order, and n + 1 offsets."""
    words = Words(LOWER[raw], at)
    sums, doc = N1.sums(words.hashes()), words.doc()
    fits = words.fits(size)
    keys, owner = N1.windows(sums, size)[fits], doc[: len(fits)][fits]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        keys = np.concatenate([keys, N1.spans(sums, words.first[short], words.first[short + 1])])
        owner = np.concatenate([owner, short])
    order = np.argsort(in_doc(keys, owner), kind="stable")
    k, o = keys[order], owner[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    first = order[fresh]
    first = first[np.lexsort((keys[first], owner[first]))]
    return keys[first], np.searchsorted(owner[first], np.arange(len(at)))


def wrapped_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the set), a, b (128 bits over the set), sig (minima, uint32)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1 << 20):
            keys, at = shingle_sets(*as_bytes(col(part, "_text")))
            full = np.flatnonzero(np.diff(at))
            sig = np.zeros((part.num_rows, COORDINATES), np.uint32)
            x = (keys >> np.uint64(32)).astype(np.uint32)
            for k in range(COORDINATES if len(full) else 0):
                y = (x ^ FLIP[k]) * TIMES[k]
                y ^= y >> np.uint32(15)
                y *= AGAIN[k]
                sig[full, k] = np.minimum.reduceat(y, at[full])
            columns = [col(part, "_id"), np.diff(at), wrapped_sums(mix(keys), at), wrapped_sums(mix(~keys), at)]
            yield pa.RecordBatch.from_arrays([columns[0], *map(pa.array, columns[1:]), pa.array([r.tobytes() for r in sig], pa.binary())], ["id", "n", "a", "b", "sig"])

    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return picked.mapInArrow(work, "id long, n long, a long, b long, sig binary")


def postings(classes: DataFrame) -> DataFrame:
    """token, rep, n, w: each class under the shared ones of its PREFIX rarest (coordinate, value) pairs; w: all that it shares."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(col(batch, "sig").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.int64)
                token = sig + (np.arange(COORDINATES, dtype=np.int64) << 32)
                yield pa.RecordBatch.from_arrays([pa.array(token.ravel()), pa.array(np.repeat(col(batch, "rep").to_numpy(), COORDINATES)), pa.array(np.repeat(col(batch, "n").to_numpy(), COORDINATES))], ["token", "rep", "n"])

    tokens = classes.select("rep", "n", "sig").mapInArrow(work, "token long, rep long, n long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1")
    # a list has COORDINATES entries at most (more only where texts share an id)
    mine = tokens.join(shared, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("l"))
    prefix = F.expr(f"slice(l, 1, greatest(size(l) - {COORDINATES - PREFIX}, 0))")
    return mine.select("rep", "n", F.size("l").alias("w"), F.explode(prefix).alias("p")).select(F.col("p.token").alias("token"), "rep", "n", "w")


def alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (x, y) whose signatures collide at least MATCHES times."""
    sigs = classes.select("rep", "sig")
    both = pairs.join(sigs.toDF("x", "sx"), "x").join(sigs.toDF("y", "sy"), "y").select("x", "y", "sx", "sy")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sx, sy = (np.frombuffer(b"".join(col(batch, c).to_pylist()), np.uint32).reshape(-1, COORDINATES) for c in ("sx", "sy"))
                ok = pa.array((sx == sy).sum(1) >= MATCHES)
                yield batch.select(["x", "y"]).filter(ok)

    return both.mapInArrow(work, "x long, y long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    both = pairs.join(texts.toDF("x", "nx", "tx"), "x").join(texts.toDF("y", "ny", "ty"), "y").select("x", "y", "nx", "tx", "ny", "ty")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[bytes, np.ndarray]] = {}

        def shingles(key: int, size: int, data: bytes) -> np.ndarray:
            if key not in kept or kept[key][0] != data:
                if len(kept) >= 64:
                    kept.clear()
                kept[key] = data, shingle_sets(unpack_text(data, size), np.array([0, size]))[0]
            return kept[key][1]

        for batch in batches:
            ok = []
            for x, y, nx, tx, ny, ty in zip(*(col(batch, c).to_pylist() for c in ("x", "y", "nx", "tx", "ny", "ty")), strict=True):
                p, q = shingles(x, nx, tx), shingles(y, ny, ty)
                both_ = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both_ >= percent * (len(p) + len(q) - both_))
            yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(work, "x long, y long").distinct()


def shingle_rows(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """token, rep, n, w, comp: each of reps (rep, n, comp) under those of the shingles it shares that a pair must meet in;
    w: how many it shares from there on, the rarest first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, size, data in zip(*(col(batch, c).to_pylist() for c in ("id", "size", "data")), strict=True):
                keys = shingle_sets(unpack_text(data, size), np.array([0, size]))[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), key, np.int64))], ["shingle", "rep"])

    flat = cut(texts.join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").mapInArrow(work, "shingle long, rep long"), "shingles")
    shared = flat.groupBy("shingle").agg(F.count("*").alias("freq")).where("freq > 1")
    from_here = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("freq"), F.desc("shingle")))
    ranked = flat.join(shared, "shingle").join(reps, "rep").select(F.col("shingle").alias("token"), "rep", "n", from_here.alias("w"), "comp")
    return ranked.where(f"100 * w >= {PERCENT} * n")


def viable(lists: DataFrame) -> DataFrame:
    """The entries that the least other set of their list could make a pair with."""
    least = lists.groupBy("token").agg(F.min("n").alias("lo"))
    m = f"greatest(lo, {PERCENT} * n / 100)"
    return lists.join(least, "token").where(f"100 * w >= {PERCENT} * (n + {m} - w)").drop("lo")


#: Edges that one task joins by itself; more edges are first joined in so many parts.
LOCAL_EDGES = 1_000_000


def joined_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of one task -> (node, least node that it is joined with there)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    for batch in batches:
        for u, v in zip(*(col(batch, c).to_pylist() for c in ("u", "v")), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for lo in range(0, len(nodes), 50_000):
        part = nodes[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])


def components(edges: DataFrame, local: int = LOCAL_EDGES, rounds: int = 60) -> DataFrame:
    """node, comp (the least node reachable) for the nodes of edges (x, y) that aren't their component's least.

    Tasks join up to `local` edges each; where there was more than one task, their results are joined by large-star
    and small-star steps.
    """
    now = cut(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")), "edges")
    tasks = -(-now.count() // local)
    old, now = now, cut(now.coalesce(max(1, tasks)).mapInArrow(joined_here, "u long, v long"), "forest")
    release(old)
    mark = None
    for _ in range(rounds if tasks > 1 else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        old, now = now, cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        release(old)
        seen = tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if seen == mark:
            break
        mark = seen
    else:
        if tasks > 1:
            raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))


#: Rounds of hubs over the lists of signature coordinates, and over those of shingles.
HUB_ROUNDS, MORE_ROUNDS = 2, 3


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (least id reachable), kept (it is its component's least)."""
    spark = docs.sparkSession
    signed = cut(signatures(docs, id_col, text_col), "signatures")
    full = signed.where("n > 0 and id is not null")
    classes = cut(full.groupBy("a", "b", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "classes")
    lists = cut(postings(classes), "postings")
    lists = lists.join(lists.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "token")
    lists = cut(lists, "lists")
    tidy(spark)

    # the texts of classes that meet another, compressed
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            raw, at = as_bytes(col(part, "_text"))
            yield pa.RecordBatch.from_arrays([col(part, "id"), pa.array(np.diff(at)), pa.array([pack_text(raw[at[i] : at[i + 1]]) for i in range(part.num_rows)], pa.binary())], ["id", "size", "data"])

    picked = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    meet = lists.select(F.col("rep").alias("id")).distinct()
    texts = cut(picked.mapInArrow(compress, "id long, size long, data binary").join(meet, "id", "left_semi"), "texts")
    tidy(spark)

    # rows that share an id link the classes of their texts
    member = full.join(classes.select("a", "b", "n", "rep"), ["a", "b", "n"]).select("id", "rep")
    links = cut(member.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("x", "y").distinct(), "links")
    tried = None

    def placed(now: DataFrame) -> DataFrame:
        """The entries of lists that hold several components, with their components."""
        at = now.drop("comp").join(components(links), now.rep == F.col("node"), "left").drop("node").withColumn("comp", F.coalesce("comp", "rep"))
        open_ = at.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        return cut(at.join(open_, "token"), "open")

    def settle(pairs: DataFrame) -> None:
        nonlocal links, tried
        close = pairs.where(f"100 * least(n, m) >= {PERCENT} * greatest(n, m)").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x < y").distinct()
        if tried is not None:
            close = close.join(tried, ["x", "y"], "left_anti")
        close = cut(alike(close, classes).distinct(), "candidates")
        links = cut(links.unionByName(confirmed(close, texts)), "links")
        tried = close if tried is None else tried.unionByName(close)
        tidy(spark)

    def hubs(now: DataFrame, also: str = "true") -> DataFrame:
        """Compares each list (entries token, rep, n, w, comp) with its hub, the greatest w; the entries still to compare."""
        best = F.struct((-F.col("w")).alias("w"), F.xxhash64("rep").alias("h"), F.col("rep").alias("y"), F.col("n").alias("m"), F.col("comp").alias("other"))
        hub = cut(now.groupBy("token").agg(F.min(best).alias("hub")).select("token", "hub.y", "hub.m", "hub.other", (-F.col("hub.w")).alias("r")), "hubs")
        both = now.join(hub, "token")
        settle(both.where("comp <> other").where(also).select(F.col("rep").alias("x"), "y", "n", "m"))
        return placed(both.where("rep <> y").select(*now.columns))

    now = lists.withColumn("comp", F.col("rep"))
    for _ in range(HUB_ROUNDS):
        now = hubs(now)
    now = placed(viable(cut(shingle_rows(texts, now.select("rep", "n", "comp").distinct()), "shared")))
    # as many shingles as remain to both from a shared one on must be enough
    enough = f"100 * least(w, r) >= {PERCENT} * (n + m - least(w, r))"
    for _ in range(MORE_ROUNDS):
        if now.isEmpty():
            break
        now = hubs(now, enough)
    main = now.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "comp")).alias("main")).select("token", F.col("main.comp").alias("main"))
    now = now.join(main, "token").withColumn("lesser", F.expr("comp <> main"))
    other = now.select("token", F.col("rep").alias("y"), F.col("n").alias("m"), F.col("comp").alias("other"), F.col("w").alias("r"), F.col("lesser").alias("also"))
    settle(now.where("lesser").join(other, "token").where(f"comp <> other and (rep < y or not also) and {enough}").select(F.col("rep").alias("x"), "y", "n", "m"))
    found = components(links)
    reps = classes.join(found, classes.rep == found.node, "left").select("a", "b", "n", F.coalesce("comp", "rep").alias("comp"))
    own = signed.select("id", "n", "a", "b").join(reps, ["a", "b", "n"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))
