"""Word-window and line-window chunkers, and the cap per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def starts(n: Column, size: int, overlap: int) -> Column:
    """Starts (from 0) of windows over n items: the last window is the first that reaches the end."""
    step = max(1, size - overlap)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def text_windows(files: DataFrame, size: int = 180, overlap: int = 30) -> DataFrame:
    """name, content -> file, seq, source (name#i), text, kind: windows of words joined by single spaces."""
    w = files.select("name", X.words(F.col("content")).alias("w"))
    out = w.select("name", "w", F.posexplode(starts(F.size("w"), size, overlap)).alias("seq", "at"))
    return out.select(
        F.col("name").alias("file"), F.col("seq").cast("long").alias("seq"), F.format_string("%s#%d", "name", "seq").alias("source"),
        F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("text"), F.lit("text").alias("kind"),
    )


def line_windows(files: DataFrame, size: int = 60, overlap: int = 10, header: bool = True) -> DataFrame:
    """name, content -> file, seq, source (name:a-b), text (under a metadata header), kind."""
    rows = files.select("name", X.lines(F.col("content")).alias("l")).withColumn("n", F.size("l"))
    out = rows.select("name", "l", "n", F.posexplode(starts(F.col("n"), size, overlap)).alias("seq", "at"))
    first, last = F.col("at") + 1, F.least(F.col("at") + size, "n")
    body = F.array_join(F.slice("l", first, size), "\n")
    return out.select(
        F.col("name").alias("file"), F.col("seq").cast("long").alias("seq"), F.format_string("%s:%d-%d", F.col("name"), first, last).alias("source"),
        (X.metadata_header(F.col("name"), body, first, last) if header else body).alias("text"), F.lit("block").alias("kind"),
    )


def cap_per_file(chunks: DataFrame, most: int, file: str = "file", order: str = "seq") -> DataFrame:
    """The first `most` chunks of each file, in order; 0 is no cap.  Spark prunes groups before the shuffle."""
    if not most:
        return chunks
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def not_blank(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.where(F.trim(F.col(text), F.lit(" \t\r\n")) != "")


def with_search_columns(chunks: DataFrame) -> DataFrame:
    """The derived columns of the store: text_lc and words."""
    return chunks.withColumns({"text_lc": F.lower("text"), "words": X.word_count(F.col("text"))})
