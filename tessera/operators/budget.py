"""Token budgets: grouping of exchanges, eviction, and packing by running cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Tokens per message that its content doesn't show, and the margin at the window's edge.
PER_MESSAGE, PROMPT_TAIL, OUTPUT_RESERVE = 8, 16, 512


def exchange_groups(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of user, assistant and tool with grp, the running count of user turns; what precedes the first
    user turn is dropped.  tokens has the estimated cost."""
    kept = messages.where(F.col("role").isin("user", "assistant", "tool"))
    order = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    grouped = kept.withColumn("grp", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order).cast("long"))
    return grouped.where("grp > 0").withColumn("tokens", X.estimate_tokens(F.col("text")) + PER_MESSAGE)


def evict_to_fit(messages: DataFrame, cap: int, need: int, conv: str = "conv_id") -> DataFrame:
    """Messages (conv, grp, tokens, pinned) that stay when the oldest whole groups go until total + need <= cap.

    A group goes if the total without all evictable groups before it is still too much; the newest group and
    groups with a pinned member never go, so the rest may still be too much.
    """
    whole = Window.partitionBy(conv)
    groups = messages.groupBy(conv, "grp").agg(F.sum("tokens").alias("cost"), F.bool_or("pinned").alias("pin"))
    groups = groups.withColumns({"total": F.sum("cost").over(whole), "newest": F.max("grp").over(whole)})
    groups = groups.withColumn("can_go", ~F.col("pin") & (F.col("grp") != F.col("newest")))
    before = F.coalesce(F.sum(F.when(F.col("can_go"), F.col("cost")).otherwise(0)).over(whole.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gone = groups.withColumn("gone", F.col("can_go") & (F.col("total") - before + need > cap)).where("gone").select(conv, "grp")
    return messages.join(gone, [conv, "grp"], "left_anti")


def prefix_pack(hits: DataFrame, budget: int, header_cost: int, key: str = "query_id", rank: str = "rank", cost: str = "cost") -> DataFrame:
    """The first hit always, then hits while the running cost stays in the budget."""
    order = Window.partitionBy(key).orderBy(rank)
    run = F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0)) + header_cost
    # costs are positive, so the running sum can't come back under the budget once it is over
    return hits.withColumns({"used": run.cast("long"), "_n": F.row_number().over(order)}).where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


def pinned_pack(files: DataFrame, budget: int, key: str = "conv_id", rank: str = "rank") -> DataFrame:
    """key, rank, name, language, content -> the files that fit the budget in order, as `piece`; where not even the
    first fits and there is room, its head, cut at a line."""
    header = "\n\n--- pinned code context (persists across the whole conversation) ---\n"
    base = -(-len(header.encode()) * 10 // 32)
    lang = F.when(F.coalesce("language", F.lit("")) == "", "text").otherwise(F.col("language"))

    def fenced(name, content):
        return F.concat(F.lit("\n--- "), name, F.lit(" ---\n```"), F.col("lang"), F.lit("\n"), content, F.lit("\n```\n"))

    order = Window.partitionBy(key).orderBy(rank)
    rows = files.withColumn("lang", lang).withColumn("piece", fenced(F.col("name"), F.col("content")))
    rows = rows.withColumn("cost", X.estimate_tokens(F.col("piece"), F.col("lang")))
    rows = rows.withColumns({"used": (F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)) + base).cast("long"), "_n": F.row_number().over(order)})
    whole = rows.where(F.col("used") <= budget).select(key, rank, "name", "piece", "used", F.lit(False).alias("truncated"))
    room = budget - base
    head_bytes = F.floor((room - 32) * X.chars_per_token(F.col("lang"))).cast("long")
    head = rows.where((F.col("_n") == 1) & (F.col("used") > budget) & (head_bytes < F.octet_length("content")) & F.lit(room > 64))
    cut = head.select(key, rank, "name", fenced(F.concat("name", F.lit(" (truncated)")), X.prefix_at_line(F.col("content"), head_bytes)).alias("piece"), F.lit(base).cast("long").alias("used"), F.lit(True).alias("truncated"))
    return whole.unionByName(cut)
