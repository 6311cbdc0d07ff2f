"""Indexes of texts: words and their n-grams for substring terms, trigram posting lists for regular expressions.

TermIndex answers how often a term is a substring of a text.  Terms hold no character at which texts are cut, so an
occurrence lies within one word, and it is enough to match terms with the distinct words: by the rarest n-gram of a
term, then by a look at the word.  Texts themselves aren't read again.

GrepIndex answers which files may hold a match of a regular expression.  Each task writes one segment: for each
trigram of its files, their numbers.  Nothing is shuffled, a segment's rows are in order of the trigram, so that a
look-up reads only the row groups with the trigrams that it asks for, and new files make new segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete

#: Where texts are cut into words, as queries are into terms.
CUT = r"[\s:.()]+"
SIZES = (1, 2, 3)


def grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


class TermIndex:
    """grams: gram, word.  postings: word, chunk_id, n (how often the word stands in that text)."""

    def __init__(self, spark: SparkSession, path: str):
        """The index below `path`."""
        self.spark, self.path = spark, path
        self.grams, self.postings = spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/postings")

    @classmethod
    def build(cls, chunks: DataFrame, path: str, text_lc: str = "text_lc", key: str = "chunk_id") -> TermIndex:
        """Writes the index of all texts; a null text has no words."""
        spark = chunks.sparkSession
        words = chunks.select(F.col(key).alias("chunk_id"), F.explode(F.split(F.col(text_lc), CUT)).alias("word")).where("word <> ''")
        words.groupBy("word", "chunk_id").agg(F.count("*").alias("n")).write.parquet(f"{path}/postings")
        distinct = spark.read.parquet(f"{path}/postings").select("word").distinct()
        distinct.select(F.explode(F.concat(*(grams(F.col("word"), k) for k in SIZES))).alias("gram"), "word").write.parquet(f"{path}/grams")
        return cls(spark, path)

    def matches(self, terms: DataFrame) -> DataFrame:
        """terms (distinct, not empty) -> term, word, times: the words that hold each term, and how often (without overlap)."""
        size = F.least(F.char_length("term"), F.lit(max(SIZES)))
        own = F.when(size < max(SIZES), F.array("term")).otherwise(grams(F.col("term"), max(SIZES)))
        asked = terms.select("term", F.explode(own).alias("gram"))
        count = self.grams.join(asked.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("words"))
        # the rarest gram of a term; a term with a gram that no word has, has no match
        rarest = asked.join(count, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("words", F.lit(0)), F.col("gram"))).alias("gram"))
        held = rarest.join(self.grams, "gram").where(F.contains("word", F.col("term")))
        times = (F.char_length("word") - F.char_length(F.replace("word", F.col("term"), F.lit("")))) / F.char_length("term")
        return held.select("term", "word", times.cast("long").alias("times"))

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """terms (distinct) -> term, chunk_id, tf, for the texts that hold the term."""
        found = self.matches(terms).join(self.postings, "word")
        return found.groupBy("term", "chunk_id").agg(F.sum(F.col("times") * F.col("n")).alias("tf"))

    def drop(self) -> None:
        delete(self.spark, self.path)


# --- trigrams that a regular expression requires ---------------------------------------------
#
# A requirement is True (none), a trigram, or ("and" | "or", requirements).

#: Strings that a stretch of an expression may stand for, and characters of a class that are taken one by one.
MOST_STRINGS, MOST_CHARACTERS = 16, 4


def fold(text: str) -> str:
    """A-Z in lower case, and nothing else."""
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def trigrams(text: bytes) -> list[int]:
    return [text[i] << 16 | text[i + 1] << 8 | text[i + 2] for i in range(len(text) - 2)]


def both(parts: list):
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(parts: list):
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def told(strings: set[str]):
    return either([both(trigrams(fold(s).encode())) for s in sorted(strings)])


def plain_syntax(pattern: str) -> bool:
    """Only what both dialects, the parser's here and that of the search, read alike."""
    body = pattern[4:] if pattern.startswith("(?i)") else pattern
    body = re.sub(r"\\[dDwWsSbB]|\\[^0-9A-Za-z]", "_", body)  # escapes of classes, edges and punctuation
    classes = re.findall(r"\[(\^?\]?[^\]]*)\]", body)
    return "\\" not in body and "(?" not in body.replace("(?:", "") and not any("[" in c or "&&" in c or c.lstrip("^").startswith("]") for c in classes)


def required(pattern: str):
    """The trigrams (of UTF-8 bytes, A-Z folded) that every line with a match holds; True where nothing can be said."""
    if not plain_syntax(pattern):
        return True
    try:
        tree = _parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return True
    return sequence(tree)[1]


def strings_of(op, arg) -> set[str] | None:
    """All that an element may stand for, if that is a few strings."""
    if op is C.LITERAL:
        return {chr(arg)}
    if op is C.IN and all(o is C.LITERAL or o is C.RANGE and a[1] - a[0] < MOST_CHARACTERS for o, a in arg):
        out = {chr(x) for o, a in arg for x in ([a] if o is C.LITERAL else range(a[0], a[1] + 1))}
        return out if len(out) <= MOST_CHARACTERS else None
    if op is C.SUBPATTERN:
        return sequence(arg[3])[0]
    if op is C.BRANCH:
        parts = [sequence(x)[0] for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == arg[1] == 1:
        return sequence(arg[2])[0]
    return {""} if op is C.AT else None


def sequence(elements) -> tuple[set[str] | None, object]:
    """(the strings that the elements may stand for, or None; what they require)."""
    whole, run, need = True, {""}, []
    for op, arg in elements:
        some = strings_of(op, arg)
        if some is not None and len(run) * len(some) <= MOST_STRINGS:
            run = {a + b for a in run for b in some}
            continue
        whole = False
        need.append(told(run))
        run = {""}
        if some is not None and len(some) <= MOST_STRINGS:
            run = some
        elif op is C.SUBPATTERN:
            need.append(sequence(arg[3])[1])
        elif op is C.BRANCH:
            need.append(either([sequence(x)[1] for x in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
            need.append(sequence(arg[2])[1])
    return (run if whole else None), both([*need, told(run)])


def asked_trigrams(need) -> set[int]:
    return set() if need is True else {need} if isinstance(need, int) else set().union(*map(asked_trigrams, need[1]))


def holds(need, have: Column) -> Column:
    """Whether an array of trigrams meets a requirement."""
    if isinstance(need, int):
        return F.array_contains(have, need)
    parts = [holds(p, have) for p in need[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if need[0] == "and" else out | p
    return out


class GrepIndex:
    """segments: segment, trigram, files (their numbers in the segment).  names: segment, file, path."""

    def __init__(self, spark: SparkSession, path: str):
        """The index below `path`."""
        self.spark, self.path = spark, path
        self.segments = spark.read.schema("segment bigint, trigram int, files array<int>").parquet(f"{path}/segments")
        self.names = spark.read.schema("segment bigint, file int, path string").parquet(f"{path}/names")

    @classmethod
    def build(cls, files: DataFrame, path: str, first_segment: int = 0) -> GrepIndex:
        """Writes segments for files (path, text), from number `first_segment` on: one for each task and batch of rows.

        A null text has no lines; line ends aren't part of trigrams.
        """
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            base = first_segment + (TaskContext.get().partitionId() << 24)
            for made, batch in enumerate(batches):
                pairs = [found(x) for x in batch.column(1).to_pylist()]
                file = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs]).astype(np.int32)
                gram = np.concatenate(pairs) if pairs else np.zeros(0, np.int32)
                order = np.argsort(gram, kind="stable")
                gram, file = gram[order], file[order]
                at = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(gram)), pa.int32()), pa.array(file))
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, base + made)), pa.array(gram[at], pa.int32()), lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names)
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, base + made)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int32())), pa.array(np.arange(k), pa.int32()), batch.column(0)], names)

        names = ["segment", "trigram", "files", "file", "path"]
        out = files.select("path", "text").mapInArrow(work, "segment bigint, trigram int, files array<int>, file int, path string")
        staged = f"{path}/staged-{first_segment}"
        out.write.option("compression", "zstd").parquet(staged)
        both_ = files.sparkSession.read.parquet(staged)
        both_.where("trigram is not null").select("segment", "trigram", "files").sortWithinPartitions("segment", "trigram").write.mode("append").option("compression", "zstd").parquet(f"{path}/segments")
        both_.where("file is not null").select("segment", "file", "path").write.mode("append").parquet(f"{path}/names")
        delete(files.sparkSession, staged)
        return cls(files.sparkSession, path)

    def candidates(self, need) -> DataFrame:
        """path: files that may hold a match of an expression with this requirement (not True); one row for each row of `names`."""
        asked = self.segments.where(F.col("trigram").isin(sorted(asked_trigrams(need))))
        have = asked.select("segment", F.explode("files").alias("file"), "trigram").groupBy("segment", "file").agg(F.collect_set("trigram").alias("have"))
        return self.names.join(have.where(holds(need, F.col("have"))).select("segment", "file"), ["segment", "file"], "left_semi").select("path")


def found(text: str | None) -> np.ndarray:
    """The distinct trigrams of a text's lines."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.int32)
    if len(raw) < 3:
        return np.zeros(0, np.int32)
    end = raw == 10
    gram = np.unique((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])[~(end[:-2] | end[1:-1] | end[2:])])
    return gram.astype(np.int32)
