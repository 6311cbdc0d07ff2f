"""URL filter (operator 9): a blocked Bloom filter before an exact hash join, in DataFrame functions only.

A list names canonical places (host, path); one covers a URL whose host is the listed host or below
it and whose path starts with the listed path.  So the canonical keys of a URL are its host's label
suffixes, each with the prefixes of its path that are as long as some listed path.  Each key is looked
up in a blocked Bloom filter (64-bit blocks, `BITS` bits a key; a key touches one block); what passes
goes to an exact hash join with the list, which removes the false positives.  The longest listed
key wins, then the longer host.

Size: the filter is a table of (block, word), joined on the block: Spark broadcasts it only where its
known size is under spark.sql.autoBroadcastJoinThreshold, and otherwise shuffles by block.  The
distinct lengths of listed paths (bounded by the longest path) are all that the driver collects.

Defined results: a null URL, or one without `://`, has host and path empty and gets the default
verdict; an empty list gives every URL the default; repeated rows are all kept and judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits set by a key, in one 64-bit word.
BITS = 4
#: Words of filter for each listed key: 64 / 4 = 16 bits a key.
KEYS_PER_WORD = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def slot(key: Column, words: int) -> tuple[Column, Column]:
    """The filter word of a key, and the mask of its bits there."""
    bits = F.xxhash64(key, F.lit(1))
    mask = None
    for i in range(BITS):
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return F.pmod(F.xxhash64(key), F.lit(words)), mask


def filter_words(keys: DataFrame, words: int) -> DataFrame:
    """The filter as a table (_block, _word) from a table of `_key`."""
    block, mask = slot(F.col("_key"), words)
    return keys.select(block.alias("_block"), mask.alias("_mask")).groupBy("_block").agg(F.bit_or("_mask").alias("_word"))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id, host, path, rule (host + path of the winning listed key, or null), verdict.

    rules: host, path, verdict ("allow" or "block"); a host and path listed twice counts as its
    block entry.
    """
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
        .where(F.col("r_host").isNotNull())
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))
        .withColumn("_key", F.concat("r_host", F.lit("\n"), "r_path"))
    )
    count = rules.count()
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    words = 1 << max(4, math.ceil(math.log2(max(1, count) / KEYS_PER_WORD + 1)))

    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    parts = base.select("_id", "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    if not lengths:
        return parts.select(F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # canonical keys of each distinct place
    places = parts.select("host", "path").where("host <> ''").distinct()
    hosts = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    cuts = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    keyed = (
        places.select("host", "path", F.explode(hosts).alias("_h"))
        .select("host", "path", "_h", F.explode(cuts).alias("_n"))
        .select("host", "path", F.concat("_h", F.lit("\n"), F.expr("substring(path, 1, _n)")).alias("_key"))
    )
    block, mask = slot(F.col("_key"), words)
    possible = (
        keyed.select("host", "path", "_key", block.alias("_block"), mask.alias("_mask"))
        .join(filter_words(rules.select("_key"), words), "_block")
        .where(F.col("_word").bitwiseAND(F.col("_mask")) == F.col("_mask"))
    )
    won = (
        possible.join(rules, "_key")
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("_won"))
    )
    return parts.join(won, ["host", "path"], "left").select(
        F.col("_id").alias(id_col), "host", "path", F.col("_won.rule").alias("rule"), F.coalesce("_won.verdict", F.lit(default)).alias("verdict")
    )
