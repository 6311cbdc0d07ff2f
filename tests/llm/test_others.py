"""Quality classifier, page extraction, URL filter, and the pipeline."""

import brute_ as brute
import duckdb
import numpy as np
import pytest
from cases import documents, frame
from pyspark.sql import functions as F

from tessera.llm.quality_knn import held_out, keep_good, knn_quality
from tessera.llm.queries import URL_RULES, op1_knn_quality, tokenizer_path
from tessera.llm.tagpath import extract_main_text, main_text
from tessera.llm.tokens import encoder
from tessera.llm.url_bloom import filter_words, slot, url_filter

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
EMPTY = []


def test_op1_learns_from_other_labels_only(spark):
    got = op1_knn_quality(spark, SF2)
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF2}/labels.parquet'").fetchall())
    rows = [r for r in got.collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 80 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95
    assert got.count() == 1000 and got.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0


def test_op1_awkward_rows(spark):
    labels = spark.createDataFrame([(7, 1), (8, 1), (10, 1), (17, 0), (25, 0), (15, 0), (12, 1), (99, 1), (22, None), (None, 1), (7, 1)], "doc_id long, quality int")
    got = knn_quality(frame(spark), labels).collect()
    assert len(got) == len(documents()) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[11] > 0.5 and score[17] < 0.5 and score[1] == score[2] == score[3]
    assert {r["score"] for r in knn_quality(frame(spark), labels.limit(0)).collect()} == {0.5}
    assert knn_quality(frame(spark, EMPTY), labels).count() == 0
    assert keep_good(frame(spark), labels).columns == frame(spark).columns


def test_held_out_rule(spark):
    import zlib

    got = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", held_out()).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


PAGES = [
    ("<p>One</p><p>Two  and\nmore</p>", "One Two and more"),
    ("<nav><a href='/'>Home</a></nav><article><h1>T &amp; U</h1><p>Body &lt;x&gt; &eacute;&#233;.</p></article><footer>&copy; me</footer>", "T & U Body <x> éé."),
    ("<article><p>a<b>b</b>c<br>d</p><script>if (a<b) x('</p>')</script><style>p{}</style><!-- no --><p>e</article>", "abc d e"),
    ("<body><div class='cookie-notice'>We use cookies</div><main><h2>Head</h2><p>Long text, with points. And more of it.</p><aside>side</aside><form>f<input></form></main><div id='comments'><p>I disagree strongly, with a very long comment. Really, it is long.</p></div></body>", "Head Long text, with points. And more of it."),
    ("<body><div class='content'><p>First paragraph here, it is long enough.</p><ul><li>item one is kept</li><li>item two</li></ul></div><div class='sidebar'><ul><li><a href='#'>x</a></li></ul></div></body>", "First paragraph here, it is long enough. item one is kept item two"),
    ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<div class=ad>Buy</div>", ""),
    ("", ""), (None, ""), ("<>< <p", "<><"), ("plain text only", "plain text only"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_op8_main_text(page, text):
    assert main_text(page) == text


def test_op8_table(spark):
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0]), (90, None, "<p>" + "x " * 200_000 + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract_main_text(pages).collect()
    assert len(got) == len(rows) and sorted(r["text"] for r in got if r["page_id"] < 90) == sorted([t for _, t in PAGES] + [PAGES[0][1]])
    assert all(r["n_chars"] == len(r["text"]) for r in got) and max(r["n_chars"] for r in got) == 399_999
    assert extract_main_text(pages.limit(0)).count() == 0


def test_op8_generated_pages():
    import html
    import re

    for (page,) in duckdb.sql(f"select html from '{SF2}/pages.parquet'").fetchall():
        body = page.split("<article>")[1].split("</article>")[0]
        plain = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", body)))).strip()
        assert main_text(page) == plain


URLS = ["http://Example.COM/en/x?q#f", "https://www.example.com/en/", "https://www.example.com/EN/", "http://a.net/es/1", "http://a.net/esx", "http://net/fr/", "ftp://x.com", "http://com/", "no scheme", "", None, "http://", "://a.com/b", "http://x.com:80/", "http://u@x.com/", "http://a.com?x=http://b.net/es/", "http://a..com/", "http://.com/", "http://é.com/ü", "http://a.net/es/1", "http://xcom/"]


def test_op9_url_filter(spark):
    rows = list(enumerate(URLS)) + [(3, URLS[3]), (None, "http://a.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "_key": F.lit(1), "rule": F.lit(2)})
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string").withColumn("page_id", F.lit(1))
    got = sorted((tuple(r) for r in url_filter(pages, rules).collect()), key=repr)
    assert got == sorted(brute.op9(rows, URL_RULES), key=repr)
    assert {r["verdict"] for r in url_filter(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter(pages.limit(0), rules).count() == 0


def test_op9_filter_has_no_false_negatives_and_few_false_positives(spark):
    words = 1 << 10
    keys = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("_key"))
    block, mask = slot(F.col("_key"), words)

    def passed(df):
        rows = df.select("_key", block.alias("_block"), mask.alias("_mask")).join(filter_words(keys, words), "_block")
        return rows.where(F.col("_word").bitwiseAND(F.col("_mask")) == F.col("_mask")).count()

    assert passed(keys) == 4000
    assert passed(spark.range(4000).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("_key"))) < 400


def test_op9_stays_in_the_jvm(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    plan = url_filter(spark.read.parquet(f"{SF}/pages.parquet"), rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_pipeline_against_plain_versions(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = []
    for name, stage in pipeline.STAGES:
        docs = pipeline.cut(stage(spark, docs, SF), name.replace(" ", "-"))
        steps.append(docs)
    taken = [{r["doc_id"]: r["text"] for r in s.collect()} for s in steps[:4]]
    assert all(s.columns == columns for s in steps[:4])
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    assert np.mean([(d in taken[0]) == (q == 1) for d, q in labels.items()]) > 0.95
    kept = {d for d, _, _, k in brute.op10(sorted(taken[0].items())) if k}
    assert set(taken[1]) == kept and all(taken[1][d] == taken[0][d] for d in kept)
    clean = {x[0]: x[5].decode("utf-8", "ignore") for x in brute.op2(sorted(taken[1].items()), with_kept=True) if x[2] < x[1] or not x[1]}
    assert taken[2] == clean
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    assert set(taken[3]) == {x[0] for x in brute.op7(sorted(taken[2].items()), items) if not x[5]}
    lib = encoder(tokenizer_path("byte_bpe_50k.json")).library
    whole = {}
    for r in sorted(steps[4].collect(), key=lambda r: r["start"]):
        whole.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert whole == {d: [*lib.encode(t, add_special_tokens=False).ids, 1] for d, t in taken[3].items()}
