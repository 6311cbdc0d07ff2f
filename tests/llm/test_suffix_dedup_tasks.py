"""op2: how its messages are dealt to tasks, and what its suffix arrays are spared."""

import brute_ as brute
import numpy as np
import pyarrow as pa
from cases import frame

import tessera.llm.suffix_dedup as suffix_dedup_module
from tessera.llm.blocks import answer, task_count, to_blocks
from tessera.llm.common import R1
from tessera.llm.suffix_dedup import GRAM, LONG_GRAM, anchors, near, suffix_dedup

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def texts(n: int, size: int, seed: int) -> list[str]:
    made = np.random.default_rng(seed).integers(97, 123, (n, size)).astype(np.uint8)
    return [bytes(x).decode() for x in made]


def test_messages_are_dealt_to_the_tasks_asked_for(spark):
    blocks = to_blocks(frame(spark, [(i, t) for i, t in enumerate(texts(40, 500, 1))]).repartition(4))
    replies = spark.createDataFrame([], "block long, keys binary")
    out = answer(blocks, replies, lambda block, t: pa.table({"block": [block.number]}), "block long", tasks=7)
    assert out.rdd.getNumPartitions() == 7 and out.count() == blocks.count()  # by their bytes Spark would make one of them
    assert task_count(blocks) == 2  # no more than shuffle partitions


def test_owners_pieces_are_compared_by_longer_grams():
    """A string of 34 bytes in two texts: an anchor of 26 bytes is shared in most cases, one of 38 can't be."""
    at = np.array([0, 634, 1268])
    reached = {GRAM: 0, LONG_GRAM: 0}
    for seed in range(20):
        (one, two), both = texts(2, 600, seed), texts(1, 34, 100 + seed)[0]
        raw = np.frombuffer((one[:300] + both + one[300:] + two[:200] + both + two[200:]).encode(), np.uint8)
        for size in reached:
            where, keys, low = anchors(raw, at, R1.sums(raw), size)
            reached[size] += int(near(raw, at, low, np.intersect1d(keys[where < 634], keys[where >= 634])).sum())
    assert reached[GRAM] > 0 and reached[LONG_GRAM] == 0


def test_strings_around_the_window_in_many_texts(spark):
    t, hot = texts(30, 400, 4), texts(1, 90, 5)[0]
    docs = [(i, x[: 10 * i] + hot[: 45 + i] + x[10 * i :] + hot[i % 7 : 50 + i % 9] + "z" * (3 * i)) for i, x in enumerate(t)]
    got = sorted(map(tuple, suffix_dedup(frame(spark, docs)).select(COLUMNS).collect()))
    assert got == sorted(tuple(x[:5]) for x in brute.op2(docs))


def test_holders_of_a_piece_reach_over_parts_and_blocks_of_pieces(spark, monkeypatch):
    """Copies in many blocks of texts, whose pieces and holders come in parts of five rows and go to blocks of 200 bytes or four holders."""
    monkeypatch.setattr(suffix_dedup_module, "OWNED_BYTES", 200)
    monkeypatch.setattr(suffix_dedup_module, "OWNED_HOLDERS", 4)
    one, two, *more = texts(12, 700, 6)
    docs = [(i, x) for i, x in enumerate([*more, *[one, two[:350] + one[350:], one[90:] + two] * 4])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = sorted(map(tuple, suffix_dedup(frame(spark, docs).repartition(9)).select(COLUMNS).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(tuple(x[:5]) for x in brute.op2(docs))
