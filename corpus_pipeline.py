"""From raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept, in the columns of documents, and its decisions take effect
there; the last returns the packed pieces.  Between stages the rows are written and read again, so a
lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.llm.decontam import decontaminate
from tessera.llm.minhash_join import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality_knn import held_out, keep_good
from tessera.llm.queries import tokenizer_path
from tessera.llm.suffix_dedup import suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A text without words gets the sample's share of good labels as its score; repeated rows are judged alike.
    """
    return keep_good(docs, table(spark, sf_dir, "labels").where(~held_out()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near duplicates stays.

    Texts without words and rows with a null id stay; rows that share an id stay or go together.
    """
    key = next(x for i in range(len(docs.columns) + 1) if (x := f"gone_{i}") not in docs.columns)
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that an earlier document holds go; a text that is wholly such goes with its row.

    A character whose bytes are partly removed is left out.  A null text becomes empty; rows with a null id stay
    whole; n_chars counts the text anew.  Columns beyond those of documents are kept, whatever their names.
    """
    own = ("doc_id", "text", "n_chars")
    others = {x: f"column_{i}" for i, x in enumerate(docs.columns) if x not in own}
    cleaned = suffix_dedup(docs.select("doc_id", "text", *(F.col(f"`{x}`").alias(y) for x, y in others.items())), carry=tuple(others.values())).where("n_removed < n_bytes or n_bytes = 0")
    text = F.when(F.expr("is_valid_utf8(kept)"), F.col("kept").cast("string")).otherwise(F.expr("replace(make_valid_utf8(kept), '�', '')"))
    new = {"text": F.when(F.col("n_removed") > 0, text).otherwise(F.col("kept").cast("string"))}
    new["n_chars"] = F.length(new["text"]).cast("long")
    return cleaned.select(*((new.get(x) if x in new else F.col(others.get(x, x))).alias(x) for x in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; texts without words stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_clean=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens; an empty text is its end id."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the classifier and the tokenizer; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
