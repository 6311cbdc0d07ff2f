"""Operators over documents, against plain versions, on awkward rows and on a small table."""

import glob

import brute_ as brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from cases import PASSAGE, documents, frame, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import queries as Q
from tessera.llm.common import R1, Rolling, Words, as_bytes, winnow
from tessera.llm.decontam import decontaminate, digest
from tessera.llm.fingerprint_log import FingerprintLog, substring_dedup
from tessera.llm.minhash_join import components, near_duplicates
from tessera.llm.packing import pack
from tessera.llm.repetition import repetition_quality
from tessera.llm.simple8b import BLOCK, decode_block, encode_block, file_image, read_image, read_token_files, token_file_digest, write_token_files
from tessera.llm.suffix_dedup import suffix_dedup
from tessera.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
EMPTY = []


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def want(x):
    return sorted(map(tuple, x), key=repr)


def test_words_and_winnowing_match_plain_versions():
    import pyarrow as pa

    docs = [t for _, t in documents()]
    raw, at = as_bytes(pa.array(docs, pa.string()))
    w = Words(raw, at)
    assert [[bytes(raw[w.start[j] : w.end[j]]) for j in range(w.first[i], w.first[i + 1])] for i in range(len(docs))] == [[x.encode() for x in brute.WORD.findall(t or "")] for t in docs]
    g = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for size in (1, 2, 5, 8):
        assert set(winnow(g, size)) == {j for i in range(len(g) - size + 1) for j in range(i, i + size) if g[j] == g[i : i + size].min()}


def test_a_fresh_process_hashes_alike():
    import pyarrow as pa

    raw, _ = as_bytes(pa.array(["abc" * 3000]))
    sums = Rolling(1).sums(raw)
    assert (Rolling(1).windows(sums, 16) == R1.windows(R1.sums(raw), 16)).all()


def test_op2_suffix_dedup(spark):
    got = suffix_dedup(frame(spark), carry=("lang", "id"))
    assert {"kept", "lang", "id"} <= set(got.columns)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept") == want((*x[:5], bytearray(x[5])) for x in brute.op2(documents(), with_kept=True))
    assert suffix_dedup(frame(spark, EMPTY)).count() == 0


def test_op3_repetition(spark):
    got = repetition_quality(frame(spark))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(got, *names) == want(brute.op3(documents()))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert kept[7] and kept[12] and kept[20] and not any(kept[i] for i in (1, 2, 15, 17, 25))
    assert repetition_quality(frame(spark, EMPTY)).count() == 0


def test_op3_keeps_documents_labelled_good():
    import pyarrow as pa

    from tessera.llm.repetition import Rules, measure

    got = duckdb.sql(f"select text, quality from '{SF}/documents.parquet' join '{SF}/labels.parquet' using (doc_id)").fetchall()
    m = measure(*as_bytes(pa.array([t for t, _ in got])), Rules())
    good = np.array([q == 1 for _, q in got]) & (m["n_words"] >= 30)
    assert (m["cover_5"][good] <= 0.6).mean() > 0.98
    assert (m["n_symbols"][good] <= 0.1 * m["n_words"][good]).mean() > 0.98


def test_op4_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = pack(frame(spark), path).collect()
    lib = encoder(path).library
    expected = sorted(tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in documents())
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens, r.ids_crc32 if r.length == r.doc_tokens else 0), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and brute.crc(ids) == r.ids_crc32
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, {}).setdefault(r.start, []).append(np.frombuffer(r.ids, "<u4"))
    assert sorted(tuple(np.concatenate([x[k][0] for k in sorted(x)])) for d, x in whole.items() if d not in (22, 23)) == sorted(
        tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in documents() if d not in (22, 23)
    )
    assert sum(r.length for r in got) == sum(map(len, expected))
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        total = sum(r.length for r in s)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
        assert total <= 2048 and total & (total - 1) == 0
    assert pack(frame(spark, EMPTY), path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_equal_the_library(name):
    e = encoder(public_tokenizers.path(name))
    assert e.fast
    for _, t in documents():
        assert np.array_equal(e.ids((t or "")[:5000]), e.slow((t or "")[:5000]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30), max_size=6), st.sampled_from(["byte_bpe_50k.json", "word_bpe_49k.json"]))
def test_encoders_equal_the_library_on_any_text(parts, name):
    e, text = encoder(public_tokenizers.path(name)), " ".join(parts)
    assert np.array_equal(e.ids(text), e.slow(text))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 16), st.integers(0, (1 << 64) - 1)), max_size=300))
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    assert np.array_equal(decode_block(encode_block(x), len(x)), x)


def test_simple8b_file_round_trip():
    ids = np.random.default_rng(2).integers(0, 50_000, 3 * BLOCK + 17).astype(np.uint32)
    counts = np.array([len(ids) - 5, 0, 5])
    d, c, got = read_image(file_image(np.array([3, 4, 9]), counts, ids))
    assert list(d) == [3, 4, 9] and list(c) == list(counts) and np.array_equal(got, ids)
    with pytest.raises(AssertionError):
        read_image(file_image(d, c, ids)[:-1] + b"\x7f")


def test_op5_token_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = encoder(path).library
    coded = sorted(((d, t or "", [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in documents()), key=lambda x: (x[0], x[1]))
    start, expected = 0, []
    for d, _, ids in coded:
        expected.append((d, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert rows(token_file_digest(frame(spark), path), "doc_id", "start", "n_tokens", "ids_crc32") == want(expected)
    manifest = write_token_files(frame(spark), str(tmp_path), path, files=2)
    back = read_token_files(spark, str(tmp_path), manifest).orderBy("start").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in back] == [x[2] for x in coded]
    assert len(glob.glob(f"{tmp_path}/*.s8b")) == manifest.count()
    assert token_file_digest(frame(spark, EMPTY), path).count() == 0


def test_op6_fingerprint_log(spark):
    got = substring_dedup(frame(spark))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want(brute.op6(documents()))
    assert substring_dedup(frame(spark, EMPTY)).count() == 0


def test_op6_index_finds_what_earlier_batches_hold(spark):
    import pyarrow as pa

    def sent(block, keys):
        return (0, block, np.array(sorted(keys), np.uint64).tobytes(), np.zeros(len(keys), np.uint8).tobytes())

    schema = "bucket long, block long, keys binary, more0 binary"
    log = FingerprintLog(spark, fan_out=2)
    for i, keys in enumerate([[1, 5, 9], [5, 7], [2, 9]]):
        log.append(spark.createDataFrame([sent(i, keys)], schema))
    assert len(log.runs) <= 2
    new = spark.createDataFrame([sent(9, [2, 3, 7, 8])], schema)
    assert [np.frombuffer(r["keys"], np.uint64).tolist() for r in log.hits(new, 1).collect()] == [[2, 7]]
    log.append(new)
    assert [np.frombuffer(r["keys"], np.uint64).tolist() for r in log.hits(new, 2).collect()] == [[2, 7]]
    assert pa


ITEMS = [(1, PASSAGE), (2, "One two THREE"), (3, None), (4, ""), (5, "... --- !!!"), (6, words(1, 120)[:400]), (7, "one"), (7, PASSAGE), (None, PASSAGE)]


def test_op7_decontamination(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    expected = want(brute.op7(documents(), [x for x in ITEMS if x[0] is not None]))
    got = digest(decontaminate(frame(spark), items))
    assert rows(got, *got.columns) == expected
    # in parts, and with documents held a few at a time
    got = digest(decontaminate(frame(spark), items, part_bytes=300, hold_bytes=2000))
    assert rows(got, *got.columns) == expected
    clean = decontaminate(frame(spark), items, keep_clean=True)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(x[0] for x in expected if not x[5]) and clean.columns == frame(spark).columns
    assert decontaminate(frame(spark), items.limit(0)).where("contaminated").count() == 0
    assert decontaminate(frame(spark, EMPTY), items).count() == 0


def test_op10_near_duplicates(spark):
    got = near_duplicates(frame(spark))
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == want(brute.op10(documents()))
    assert near_duplicates(frame(spark, EMPTY)).count() == 0


def test_op10_links_a_family_without_a_common_centre(spark):
    base = words(50, 80).split(" ")
    docs = []
    for i in range(24):  # each edits its own few places; later ones drift away from the first
        x = list(base)
        for j in range(i % 7):
            x[(i * 11 + j * 13) % 80] = f"w{i}x{j}"
        docs.append((100 + i, " ".join(x)))
    assert rows(near_duplicates(frame(spark, docs)), "doc_id", "n_shingles", "component_id", "kept") == want(brute.op10(docs))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (200, 201)]
    for local in (1_000_000, 5):  # in one task, and in several
        got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "x long, y long"), local).collect()}
        assert got == {**{i: 0 for i in range(1, 31)}, 100: 90, 95: 90, 201: 200}


@pytest.mark.parametrize("name", ["op3", "op7"])
def test_registered_queries_on_a_table(spark, name):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    q = next(f for k, f in Q.queries().items() if k.startswith(name + "_"))
    got = [tuple(r) for r in q(spark, SF).collect()]
    expected = brute.op3(docs) if name == "op3" else brute.op7(docs, duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall())
    assert want(x[: len(expected[0])] for x in got) == want(expected)
