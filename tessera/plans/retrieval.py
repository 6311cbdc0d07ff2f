"""Hybrid retrieval: exact neighbours, BM25, threshold, diversity, expansion of summaries, merge of domains.

Chunks: chunk_id, source, text, kind, file, domain, vector (text_lc and words are derived where missing).
Queries: query_id, query_text, vector.  All queries of a call go through each stage together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bm25, vector
from ..operators.chunking import with_search_columns
from ..session import RetrievalOptions
from ..sources.shared import cut

DIGITS = 6


def nearest(queries: DataFrame, chunks: DataFrame, limit: int, options: RetrievalOptions, rows: int | None = None) -> DataFrame:
    """query_id, chunk_id, cos, near_rank: the nearest of all domains."""
    return vector.knn(queries, chunks, options.candidate_factor * limit, rows=rows).select("query_id", "chunk_id", "cos", F.col("rank").alias("near_rank"))


def candidates(queries: DataFrame, chunks: DataFrame, limit: int, domain: str, options: RetrievalOptions, near: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, cos: the nearest of all domains (given, or sought), then those of `domain`.

    The filter comes after the cut, so a domain can be starved by the other; that is the contract.
    """
    near = nearest(queries, chunks, limit, options) if near is None else near
    own = chunks.select("chunk_id", "domain").where(F.col("domain") == domain)
    order = Window.partitionBy("query_id").orderBy("near_rank")
    found = near.join(own, "chunk_id").withColumn("_n", F.row_number().over(order))
    return found.where(F.col("_n") <= options.pool_factor * limit).select("query_id", "chunk_id", "cos")


def weights_of(queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, float]:
    """query_id, weights of the queries' terms, written once; and the chunks' mean length."""
    return cut(bm25.prepare(queries, chunks).select("query_id", "weights"), "weights"), bm25.corpus_stats(chunks)[1]


def hybrid(found: DataFrame, queries: DataFrame, chunks: DataFrame, options: RetrievalOptions, known: tuple[DataFrame, float] | None = None) -> DataFrame:
    """Adds score: weighted cosine and saturated BM25; the cosine alone for queries without terms.  known: what weights_of() gives."""
    if options.hybrid_weight_bm25 <= 0:
        return found.withColumn("score", F.col("cos"))
    chunks = chunks if "text_lc" in chunks.columns else with_search_columns(chunks)
    asked, mean = known or weights_of(queries, chunks)
    rows = found.join(asked, "query_id").join(chunks.select("chunk_id", "text_lc", "words"), "chunk_id")
    raw = bm25.score(F.col("weights"), F.col("text_lc"), F.col("words"), mean)
    mixed = options.hybrid_weight_vector * F.col("cos") + options.hybrid_weight_bm25 * (F.col("raw") / (F.col("raw") + 1))
    scored = rows.withColumn("raw", raw).withColumn("score", F.round(F.when(F.size("weights") > 0, mixed).otherwise(F.col("cos")), DIGITS))
    return scored.select("query_id", "chunk_id", "cos", "score")


def mmr(pool: DataFrame, chunks: DataFrame, limit: int, lam: float = 0.7) -> DataFrame:
    """query_id, chunk_id, cos, score, pick: the best, then again and again the one with the greatest
    lam * score - (1 - lam) * (its greatest similarity to those picked); the earlier wins ties.

    A group is one query's pool, which the candidate factors bound.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        sims = np.round(vector.cosines(x, x), DIGITS)
        score = rows["score"].to_numpy()
        taken, left = [0], list(range(1, len(rows)))
        while len(taken) < limit and left:
            value = np.round(lam * score[left] - (1 - lam) * sims[np.ix_(left, taken)].max(1), 9)
            taken.append(left.pop(int(np.argmax(value))))
        out = rows.loc[taken, ["query_id", "chunk_id", "cos", "score"]]
        return out.assign(pick=np.arange(1, len(out) + 1))

    rows = pool.join(chunks.select("chunk_id", "vector"), "chunk_id").select("query_id", "chunk_id", "cos", "score", "vector")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, cos double, score double, pick long")


def expand_summaries(selected: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int, options: RetrievalOptions) -> DataFrame:
    """query_id, rank, chunk_id, score: each selected file_summary gives way to at most three chunks of its file that
    weren't selected, nearest first and near enough; then the first `limit`."""
    info = chunks.select("chunk_id", "kind", "file")
    chosen = selected.join(info, "chunk_id")
    summaries = chosen.where("kind = 'file_summary' and file <> ''").select("query_id", "pick", "file")
    inner = summaries.join(chunks.where("kind <> 'file_summary'").select(F.col("chunk_id").alias("child"), "file", F.col("vector").alias("child_vector")), "file")
    inner = inner.join(selected.select("query_id", F.col("chunk_id").alias("child")), ["query_id", "child"], "left_anti")
    inner = inner.join(queries.select("query_id", "vector"), "query_id").withColumn("child_cos", F.round(vector.similarity(F.col("vector"), F.col("child_vector")), DIGITS))
    near = Window.partitionBy("query_id", "pick").orderBy(F.desc("child_cos"), "child")
    children = inner.withColumn("n", F.row_number().over(near)).where("n <= 3").select("query_id", "pick", F.col("child").alias("chunk_id"), F.col("child_cos").alias("score"), "n")
    own = chosen.where("not (kind = 'file_summary' and file <> '')").select("query_id", "pick", "chunk_id", "score", F.lit(0).alias("n"))
    least = options.min_similarity

    def emit(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for _, part in rows.sort_values(["pick", "n"]).groupby("pick", sort=True):
            if part["n"].iloc[0] == 0:
                out.append((part["query_id"].iloc[0], part["chunk_id"].iloc[0], part["score"].iloc[0]))
                continue
            take = part.head(min(3, max(0, limit - len(out))))
            out += [(q, c, s) for q, c, s in zip(take["query_id"], take["chunk_id"], take["score"], strict=True) if s >= least]
        out = out[:limit]
        return pd.DataFrame({"query_id": [x[0] for x in out], "rank": range(1, len(out) + 1), "chunk_id": [x[1] for x in out], "score": [x[2] for x in out]})

    both = own.unionByName(children)
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    return both.groupBy("query_id").applyInPandas(emit, f"query_id {kinds['query_id']}, rank long, chunk_id {kinds['chunk_id']}, score double")


def once(chunks: DataFrame) -> DataFrame:
    """The chunks with what searches derive from them, written, as a dozen steps read them."""
    return cut(chunks if "text_lc" in chunks.columns else with_search_columns(chunks), "chunks")


def search(
    queries: DataFrame, chunks: DataFrame, limit: int = 5, domain: str = "code", options: RetrievalOptions = RetrievalOptions(), near: DataFrame | None = None, known: tuple[DataFrame, float] | None = None
) -> DataFrame:
    """query_id, rank, chunk_id, source, text, score: search in one domain.  near, known: what nearest() and weights_of() give."""
    chunks = once(chunks) if near is None else chunks
    found = candidates(queries, chunks, limit, domain, options, near)
    pool = hybrid(found, queries, chunks, options, known).where(F.col("score") >= options.min_similarity)
    final = expand_summaries(mmr(pool, chunks, limit, options.mmr_lambda), queries, chunks, limit, options)
    return final.join(chunks.select("chunk_id", "source", "text"), "chunk_id").select("query_id", "rank", "chunk_id", "source", "text", "score")


def retrieve(queries: DataFrame, chunks: DataFrame, limit: int = 5, options: RetrievalOptions = RetrievalOptions()) -> DataFrame:
    """Search in both domains, merged by score (code first on ties), the best `limit`; an error if retrieval is off.

    Neighbours and terms don't depend on the domain: they are sought once, and written for both.
    """
    if not options.enabled:
        raise ValueError("retrieval is disabled")
    chunks = once(chunks)
    near, known = cut(nearest(queries, chunks, limit, options, chunks.count()), "near"), weights_of(queries, chunks) if options.hybrid_weight_bm25 > 0 else None
    code, prose = (search(queries, chunks, limit, d, options, near, known).withColumn("part", F.lit(i)) for i, d in enumerate(("code", "text")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "part", "rank")
    both = code.unionByName(prose).withColumn("merged", F.row_number().over(order).cast("long")).where(F.col("merged") <= limit)
    return both.select("query_id", F.col("merged").alias("rank"), "chunk_id", "source", "text", "score")


def search_results(hits: DataFrame) -> DataFrame:
    """query_id, result: hits as the text of a tool result."""
    piece = F.format_string("[%s] (score %.3f)\n%s\n\n", "source", "score", "text")
    ordered = F.array_sort(F.collect_list(F.struct("rank", piece.alias("piece"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x.piece), "").alias("result"))


def clamp_limit(limit: int | None) -> int:
    return min(20, max(1, 5 if limit is None else limit))
