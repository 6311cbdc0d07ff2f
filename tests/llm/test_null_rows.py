"""Rows with a null id, empty tables and clashing columns in every operator and stage."""

import brute_ as brute
import pytest
from cases import documents, frame, words
from pyspark.sql import functions as F

from tessera.llm import minhash_join, suffix_dedup
from tessera.llm.packing import pack
from tessera.llm.queries import tokenizer_path

NULL = [(None, words(1, 120)), (None, None), (None, " x\ty ")]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_op2_keeps_rows_with_a_null_id_whole(spark):
    got = suffix_dedup.suffix_dedup(frame(spark, documents()[:12] + NULL), carry=("lang",))
    plain = [x[:5] for x in brute.op2(documents()[:12])] + [(None, len((t or "").encode()), 0, 0, brute.sha(t or "")) for _, t in NULL]
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(plain, key=repr)
    assert {r["lang"] for r in got.collect()} == {"en"}


def test_op10_links_rows_with_a_null_id_with_nothing(spark):
    got = minhash_join.near_duplicates(frame(spark, documents()[:12] + NULL))
    plain = brute.op10(documents()[:12]) + [(None, len(brute.shingles(t)), None, True) for _, t in NULL]
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(plain, key=repr)


def test_op10_settles_a_cloud_around_the_threshold(spark):
    import random

    r, base, docs = random.Random(5), words(60, 100).split(" "), []
    for i in range(160):
        x = list(base)
        for j in r.sample(range(100), r.randint(0, 6)):
            x[j] = f"w{i}x{j}"
        docs.append((1000 + i, " ".join(x)))
    got = minhash_join.near_duplicates(frame(spark, docs))
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.op10(docs), key=repr)


def test_op4_takes_ids_of_any_type(spark):
    docs = frame(spark, documents()[:8] + NULL)
    for kind in ("string", "int", "smallint", "decimal(20,0)"):
        got = pack(docs.withColumn("doc_id", F.col("doc_id").cast(kind)), tokenizer_path("byte_bpe_50k.json"))
        assert got.schema["doc_id"].dataType.simpleString() == kind and got.select("doc_id").distinct().count() == 9


def test_pipeline_stages_on_awkward_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    more = [c for c in ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "block", "gone_0", "_text", "column_0", "score", "text_lc")]
    docs = frame(spark, documents() + NULL).withColumns({c: F.lit(c) for c in more})
    for i, (name, stage) in enumerate(pipeline.STAGES[:4]):
        for given in (docs, docs.limit(0)):
            got = stage(spark, given, "/root/testdata/sf0.001")
            assert got.columns == docs.columns
            kept = got.collect()
            assert len(kept) <= given.count() and all(r[c] == c for r in kept for c in more)
        if i:
            got = stage(spark, docs, "/root/testdata/sf0.001").collect()
            assert sum(r["doc_id"] is None for r in got) == 3, name
            assert all(any(r["doc_id"] == d for r in got) for d in (1, 2, 3)), name


def test_op6_keeps_rows_with_a_null_id_whole(spark):
    from tessera.llm.fingerprint_log import substring_dedup

    given = NULL + [(None, "é\x0b" + words(1, 50) + "  x")]
    got = substring_dedup(frame(spark, documents()[:12] + given))
    plain = brute.op6(documents()[:12]) + [(None, len(w), 0, brute.sha(" ".join(w))) for _, t in given for w in [brute.WORD.findall(t or "")]]
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(plain, key=repr)


def test_op6_a_log_in_a_folder_takes_batches_from_several_sessions(spark, tmp_path):
    from tessera.llm.fingerprint_log import SubstringLog

    shared = words(70, 60)
    parts = [documents()[:9], documents()[9:20], documents()[20:], [(500, words(71, 10) + " " + shared)], [(501, shared + " " + words(72, 9)), (502, words(73, 40))]]
    SubstringLog(spark, 3, fan_out=2, folder=str(tmp_path)).add_documents(frame(spark, parts[0]))
    so_far = list(parts[0])
    for part in parts[1:]:
        log = SubstringLog.open(spark, str(tmp_path))
        log.add_documents(frame(spark, part))
        so_far += part
        assert len(log.prints.runs) < 2 + 1 and len(log.windows.runs) < 2 + 1
    assert rows(SubstringLog.open(spark, str(tmp_path)).results(), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op6(so_far), key=repr)
