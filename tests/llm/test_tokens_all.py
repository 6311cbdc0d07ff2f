"""Token ids equal the library's for every code point; token files hold rows without an id."""

import random
import time

import brute_ as brute
import numpy as np
import public_tokenizers
import pytest
from cases import documents, frame

from tessera.llm.simple8b import read_token_files, token_file_digest, write_token_files
from tessera.llm.tokens import PASS, Encoder, encoder


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("shape", [":{}", "a{}b 1{}", "É{}{}s"])
def test_every_code_point(name, shape):
    e = encoder(public_tokenizers.path(name))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    if shape != ":{}":
        points = points[:0x3000] + points[0x3000::37]
    texts = [shape.replace("{}", c) for c in points]
    for lo in range(0, len(texts), 50_000):
        part = texts[lo : lo + 50_000]
        plain = e.library.encode_batch(part, add_special_tokens=False)
        assert [t for t, x in zip(part, plain, strict=True) if e.ids(t).tolist() != x.ids] == []


def test_op5_rows_with_a_null_id_come_first(spark):
    rows = documents()[:12] + [(None, "b c"), (None, None), (None, "a"), (None, "a")]
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = encoder(path).library
    coded = sorted(((d is not None, d or 0, t or "", t is not None, [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows), key=lambda x: (x[0], x[1], x[3], x[2]))
    start, plain = 0, []
    for named, d, _, _, ids in coded:
        plain.append((d if named else None, start, len(ids), brute.crc(ids)))
        start += len(ids)
    got = [tuple(r) for r in token_file_digest(frame(spark, rows), path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=repr) == sorted(plain, key=repr)
    assert np.array_equal(sorted(x[1] for x in got), sorted(x[1] for x in plain))


@pytest.mark.parametrize("shape", [":{}", "a{}b 1{}", "É{}{}s", "'{}'s"])
def test_many_texts_at_once_every_code_point(shape):
    e = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.joined
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    if shape != ":{}":
        points = points[:0x3000] + points[0x3000::37]
    texts = [shape.replace("{}", c) for c in points]
    for lo in range(0, len(texts), 50_000):
        part = texts[lo : lo + 50_000]
        ids, counts = e.many(part)
        got = np.split(ids, np.cumsum(counts)[:-1])
        plain = e.library.encode_batch(part, add_special_tokens=False)
        assert [t for t, g, x in zip(part, got, plain, strict=True) if g.tolist() != x.ids] == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_many_texts_at_once_are_the_single_ones(name):
    e = encoder(public_tokenizers.path(name))
    ends = ["'l", "don'l", "'", "''s", "'r", "'re", "they'll've 'table 's's x's", "1'd2'm", "é'LL Ä'S 's", "'ſ", "x<|endoftext|>y", "q\x1cr", "Σας ΟΔΟΣ", "İ's"]
    texts = [None, *ends, "", *[t for _, t in documents()], *ends[::-1], None]
    big = " ".join(f"w{i}x" for i in range(PASS // 8))  # several passes
    for part in (texts, [], [None], ["", None, ""], ["'l"], ["a", "Σ", "b"], [big, "end", big + "é", "", "it's"]):
        ids, counts = e.many(part)
        single = [e.slow(x or "") if part is texts else e.ids(x) for x in part]
        assert counts.tolist() == [len(x) for x in single]
        assert np.array_equal(ids, np.concatenate([np.zeros(0, np.uint32), *single]))


def test_many_texts_at_once_cost_less():
    r = random.Random(4)
    stems = ["".join(r.choice("abcdeghiklmnoprstu") for _ in range(r.randint(3, 11))) for _ in range(40_000)]
    texts = [" ".join(r.choice(("{}", "{}.", "{},", "({})", "{}'s")).format(r.choice(stems)) for _ in range(600)) for _ in range(400)]
    took = []
    for encode in (lambda e: [e.ids(x) for x in texts], lambda e: e.many(texts)):
        e = Encoder(public_tokenizers.path("word_bpe_49k.json"))
        began = time.process_time()
        encode(e)
        took.append(time.process_time() - began)
    assert took[1] < 0.7 * took[0]


def test_op5_a_file_ends_with_the_document_that_fills_it(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    sized = sorted(((d, t or "") for d, t in documents()), key=lambda x: (x[0], x[1]))
    coded = [[*encoder(path).library.encode(t, add_special_tokens=False).ids, 2] for _, t in sized]
    manifest = write_token_files(frame(spark, sized), str(tmp_path), path, files=1, file_ids=500)
    files, held = [], []
    for ids in coded:
        held.append(len(ids))
        if sum(held) >= 500:
            files.append((len(held), sum(held)))
            held = []
    files += [(len(held), sum(held))] if held else []
    assert [(r.n_docs, r.n_ids) for r in manifest.orderBy("shard", "seq").collect()] == files
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in read_token_files(spark, str(tmp_path), manifest).orderBy("start").collect()] == coded
