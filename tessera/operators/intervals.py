"""Algebra of closed integer intervals, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(spans: DataFrame, key: str = "key", tolerance: int = 0) -> DataFrame:
    """key, a, b: overlapping and touching intervals of a key become one; gaps up to `tolerance` are bridged.

    A null bound sorts last and never begins an interval of its own: it is as if it touched what comes before it.
    """
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("a"), F.asc_nulls_last("b"))
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("a") > before + 1 + tolerance, 1).otherwise(0)
    islands = spans.select(key, "a", "b", fresh.alias("fresh")).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def gaps(merged: DataFrame, totals: DataFrame, key: str = "key") -> DataFrame:
    """key, a, b: what merged intervals leave of 1..total; a null key is a key, and nothing follows intervals without any end."""
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("a"))
    mine = merged.select(F.col(key).alias("_key"), "a", "b", F.lit(1).alias("_any"))
    have = totals.join(mine, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("before", F.coalesce(F.lag("b").over(order), F.lit(0)))
    inner = have.where(F.col("a").isNotNull() & (F.col("a") > F.col("before") + 1)).select(key, (F.col("before") + 1).alias("a"), (F.col("a") - 1).alias("b"))
    last = F.when(F.count("_any") > 0, F.max("b")).otherwise(F.lit(0))
    tail = have.groupBy(key, "total").agg(last.alias("last")).where("last < total").select(key, (F.col("last") + 1).alias("a"), F.col("total").alias("b"))
    return inner.unionByName(tail)


def covers(merged: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """Distinct wanted (key, a, b) with covered: its whole interval lies in one merged interval of the key.

    In order of the beginnings, one pass a key: the greatest end of those that begin no later is far enough.
    """
    have = merged.select(F.col(key), "a", F.col("b").alias("_end"), F.lit(0).alias("_asked")).where(F.col(key).isNotNull() & F.col("a").isNotNull())
    both = wanted.distinct().withColumn("_asked", F.lit(1)).unionByName(have, allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("a", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("covered", F.coalesce(F.max("_end").over(before) >= F.col("b"), F.lit(False))).where("_asked = 1").select(*wanted.columns, "covered")


def coverage(merged: DataFrame, key: str = "key", **more: Column) -> DataFrame:
    """key, n_lines: how many integers the intervals hold; and other aggregates by name."""
    return merged.groupBy(key).agg(F.sum(F.col("b") - F.col("a") + 1).cast("long").alias("n_lines"), *(c.alias(name) for name, c in more.items()))
