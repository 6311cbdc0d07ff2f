"""BM25 over substring matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import STOP_WORDS
from ..sources.shared import cut, new_path
from .text_index import CUT, TermIndex

K1, B = 1.2, 0.75


def query_terms(text: Column) -> Column:
    """Terms of a query in order, repeats kept: cut at white space and `: . ( )`, trimmed of what is neither a letter,
    a digit nor _, in lower case, without stop words."""
    parts = F.split(text, CUT)
    trimmed = F.transform(parts, lambda t: F.lower(F.regexp_replace(t, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(trimmed, lambda t: (t != "") & ~F.array_contains(stop, t))


def document_frequency(index: TermIndex, terms: DataFrame) -> DataFrame:
    """terms (distinct) -> term, df: in how many texts each term stands (0 included)."""
    found = index.frequencies(terms).groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(found, "term", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))


def corpus_stats(chunks: DataFrame, words: str = "words") -> tuple[int, float]:
    """Number of chunks, and their average length in words, at least 1."""
    n, mean = chunks.agg(F.count("*"), F.avg(words)).first()
    return n, max(mean or 0.0, 1.0)


def index_of(chunks: DataFrame) -> TermIndex:
    """An index of the chunks' texts for this session."""
    return TermIndex.build(chunks, new_path(chunks.sparkSession, "terms"))


def idf(df: Column, n: int) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def prepare(queries: DataFrame, chunks: DataFrame, text: str = "query_text", index: TermIndex | None = None) -> DataFrame:
    """queries with weights: array of struct<term, idf> in query order, repeats kept."""
    asked = queries.withColumn("_terms", query_terms(F.col(text)))
    keyed = asked.select("query_id", F.posexplode("_terms").alias("pos", "term"))
    n, _ = corpus_stats(chunks)
    known = document_frequency(index or index_of(chunks), keyed.select("term").distinct()).select("term", idf(F.col("df"), n).alias("idf"))
    weights = keyed.join(known, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "idf"))).alias("w"))
    weights = weights.select("query_id", F.transform("w", lambda x: F.struct(x.term.alias("term"), x.idf.alias("idf"))).alias("weights"))
    return asked.drop("_terms").join(weights, "query_id", "left")


def saturated(tf: Column, words: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * words / F.lit(float(mean))))


def top(queries: DataFrame, chunks: DataFrame, k: int, text: str = "query_text", index: TermIndex | None = None, digits: int = 6) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best chunks of each query, ties by chunk id; chunks without a term score 0.

    Only chunks that hold a term of a query are joined with it.  A query that has fewer than k of them takes the chunks
    with the least ids for the rest; those are among the first 2 k of all.
    """
    lengths = cut(chunks.select("chunk_id", "words"), "lengths")
    n, mean = corpus_stats(lengths)
    asked = queries.select("query_id", F.explode(query_terms(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    found = cut((index or index_of(chunks)).frequencies(asked.select("term").distinct()), "frequencies")
    weight = found.groupBy("term").agg(idf(F.count("*"), n).alias("idf"))
    hits = asked.join(weight, "term").join(found, "term").join(lengths, "chunk_id")
    part = F.col("times") * F.col("idf") * saturated(F.col("tf"), F.col("words"), mean)
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), digits).alias("score"))
    first = lengths.select("chunk_id").orderBy("chunk_id").limit(2 * k)
    zeros = queries.select("query_id").distinct().join(F.broadcast(first), F.lit(True)).withColumn("score", F.lit(0.0))  # 2 k rows are broadcast
    every = scored.unionByName(zeros).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return every.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def score(weights: Column, text_lc: Column, words: Column, mean: float) -> Column:
    """The sum over terms of idf times saturated frequency; frequencies are of substrings that don't overlap."""

    def one(w: Column) -> Column:
        tf = (F.length(text_lc) - F.length(F.replace(text_lc, w.term, F.lit("")))) / F.length(w.term)
        return F.when(tf > 0, w.idf * saturated(tf, words, mean)).otherwise(0.0)

    return F.aggregate(F.coalesce(weights, F.array().cast("array<struct<term:string,idf:double>>")), F.lit(0.0), lambda s, w: s + one(w))
