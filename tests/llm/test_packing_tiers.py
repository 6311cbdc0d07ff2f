"""Tiers and step groups of the packing operator."""

from collections import Counter, defaultdict

import public_tokenizers
from cases import words

from tessera.llm.packing import Packer, pack


def test_every_tier_closes_its_own_sequences():
    packer = Packer(2048, (16, 64, 256, 512, 1024, 2048), 4)
    lengths = [(i * 37) % 2500 + 1 for i in range(2000)]
    closed = [x for i, n in enumerate(lengths) for x in packer.add(i, n)]
    sizes = Counter(t for t, _ in closed)
    assert sizes[256] and sizes[512] and sizes[1024] and sizes[2048]
    for tier, pieces in closed:
        assert sum(n for *_, n in pieces) == tier
    # gaps of long windows hold whole shorter documents
    assert any(t == 2048 and any(start == 0 and n == lengths[i] <= 1024 for i, start, n in pieces) for t, pieces in closed)
    closed += packer.rest()
    spans = defaultdict(list)
    for _, pieces in closed:
        for i, start, n in pieces:
            spans[i].append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(spans[i]):
            assert start == at
            at += length
        assert at == n


def test_step_groups_are_even_and_belong_to_one_tier(spark):
    docs = spark.createDataFrame([(i, words(i, 20 + i * 7 % 300)) for i in range(400)], "doc_id long, text string").repartition(5)
    got = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), pool=2, step_tokens=1 << 13).collect()
    tiers, tokens = defaultdict(set), Counter()
    for r in got:
        tiers[r["step_group"]].add(r["tier"])
        tokens[r["step_group"]] += r["length"]
    assert all(len(t) == 1 for t in tiers.values()) and len({t for x in tiers.values() for t in x}) > 3
    for tier in {t for x in tiers.values() for t in x}:
        sizes = [tokens[g] for g, t in tiers.items() if t == {tier}]
        assert max(sizes) - min(sizes) <= tier
        assert len(sizes) == max(1, round(sum(sizes) / (1 << 13)))
