"""Substring terms and regular expressions through the indexes, against plain search of the texts."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.operators import bm25, search_tools
from tessera.operators.text_index import GrepIndex, TermIndex, asked_trigrams, fold, required, trigrams

TEXTS = [
    None, "", "   \n", "The theme; then the THE", "a.b:c(d)e aaa aaaa aaaaa", "naïve NAÏVE straße İstanbul 日本語テキスト", "parse_x(parse_xx): x", "don't a-b a–b", "x" * 5000 + "y" + "x" * 30,
    "😀😀 smile😀d", "one two three\nfour five", "the the the the", "tab\tand\x0bvt\x0cff\x85nel nbsp",
]
TERMS = ["the", "a", "aa", "aaa", "x", "xy", "xyx", "parse_x", "ï", "日", "日本", "日本語", "😀", "😀d", "don't", "a-b", "–", "absent", "zz", "ne two", "i̇s", "nel", "\x85"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(2, "the second row of id two", 1)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, word int").withColumn("text_lc", F.lower("text"))
    return TermIndex.build(chunks.repartition(3), f"file://{tmp_path_factory.mktemp('terms')}/i"), [(i, (t or "").lower()) for i, t, _ in rows]


def test_substring_frequencies(spark, index):
    built, texts = index
    got = {(r["term"], r["chunk_id"]): r["tf"] for r in built.frequencies(spark.createDataFrame([(t,) for t in TERMS], "term string")).collect()}
    want = {}
    for t in TERMS:
        for i, text in texts:
            n = sum(w.count(t) for w in re.split(r"[ \t\n\x0b\f\r:.()]+", text))
            if n:
                want[t, i] = want.get((t, i), 0) + n
    assert got == want and ("ne two", 10) not in got
    df = {r["term"]: r["df"] for r in bm25.document_frequency(TermIndex(spark, built.path), spark.createDataFrame([("the",), ("absent",)], "term string")).collect()}
    assert df == {"the": 3, "absent": 0}


def test_terms_meet_words_that_hold_their_rarest_gram(spark, index):
    built, _ = index
    held = built.matches(spark.createDataFrame([("parse_x",), ("aaaa",)], "term string")).collect()
    assert sorted((r["term"], r["word"], r["times"]) for r in held) == [("aaaa", "aaaa", 1), ("aaaa", "aaaaa", 1), ("parse_x", "parse_x", 1), ("parse_x", "parse_xx", 1)]


def test_top_chunks_fill_up_with_zeros(spark):
    chunks = spark.createDataFrame([(i, f"word{i % 4} filler alpha" if i > 6 else "nothing here", 3) for i in range(12)], "chunk_id long, text_lc string, words int")
    queries = spark.createDataFrame([(1, "alpha WORD1"), (2, ""), (3, "here"), (4, None)], "query_id long, query_text string")
    got = {}
    for r in bm25.top(queries, chunks, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"] > 0))
    assert [c for c, _ in got[1]] == [9, 7, 8, 10, 11, 0] and got[1][-1] == (0, False) and got[1][0][1]
    assert got[2] == [(i, False) for i in range(6)] == got[4] and got[3] == [(i, True) for i in range(6)]


# --- regular expressions -----------------------------------------------------------------------


@pytest.mark.parametrize(
    ("pattern", "some"),
    [("abc", True), ("ab", False), ("a.c", False), (r"\d+abc", True), ("(foo|barn)x", True), ("(abc|d)", False), ("x*yyyy", True), ("(abc)+", True), ("(abc)*", False), ("foo(?=x)", False), (r"\Qabc\E", False), ("[[a]b]cdef", False), ("[a&&b]cdef", False), ("(?i)ABCD", True), ("(?x)a b c d", False), ("[]a]bcd", False), ("(", False)],
)
def test_what_an_expression_requires(pattern, some):
    assert (required(pattern) is not True) == some


LINE = st.text(alphabet="abcAB1é .", max_size=14)
PIECE = st.sampled_from(["a", "b", "c", "abc", "(a|bc)", "(?:ab|c)", "[ab]", "[^a]", ".", r"\.", r"\d", "a?", "b+", "(abc)*", "(ab){2}", "é", "B", " ", "^", "$", "[a-c]", "(a|)", "ab{1}c"])


def holds(need, have):
    return need is True or (need in have if isinstance(need, int) else (all if need[0] == "and" else any)(holds(p, have) for p in need[1]))


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECE, min_size=1, max_size=6).map("".join), st.booleans(), st.lists(LINE, min_size=1, max_size=8))
def test_no_match_lacks_what_is_required(body, ignore, lines):
    pattern = ("(?i)" if ignore else "") + body
    need = required(pattern)
    for line in lines:
        if re.search(pattern, line, re.ASCII):
            assert holds(need, set(trigrams(fold(line).encode())))


FILES = [("a.rs", "fn main() {}\nlet LICENSE = 1;\nabcabc"), ("b.py", "import os\r\nabc\nbcd"), ("c", None), ("d", ""), ("dup", "abcd"), ("dup", "xbcdx\nabcd"), ("é.txt", "naïve straße\nK K"), ("long", "q" * 9000 + "needle" + "q" * 9000)]


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    rng = random.Random(5)
    more = [(f"r{i}", "\n".join("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    files = spark.createDataFrame(FILES + more, "path string, text string").repartition(4).cache()
    path = f"file://{tmp_path_factory.mktemp('trigrams')}/i"
    GrepIndex.build(files.where("path < 'r3'"), path)
    return files, GrepIndex.build(files.where("path >= 'r3'"), path, 1 << 40)  # files that come later make segments of their own


@pytest.mark.parametrize("pattern", ["abcd", "(?i)license", "bc+d a", "(abc|bcd) ?d", "needle", "ï", "ve s", r"a\sb", "^abc$", "dddd|cccc", "K", "bcd\\b", ".", "absent"])
def test_grep_with_the_index_equals_plain_grep(tree, pattern):
    files, index = tree
    for more in ({"mode": "count"}, {"context": 1}, {"mode": "files_with_matches", "scope": "src"}):
        plain, narrow = (search_tools.grep(files, pattern, limit=10**6, index=i, **more).collect() for i in (None, index))
        assert sorted(map(tuple, narrow), key=repr) == sorted(map(tuple, plain), key=repr)


def test_scanned_files_are_counted(tree):
    files, index = tree
    for use, many in ((None, files.count()), (index, 1)):
        seen = Observation()
        assert search_tools.grep(files, "needle", mode="files", index=use, scanned=seen).count() == 1
        assert seen.get["scanned_files"] == many
    need = required("bcd a")
    want = {r["path"] for r in files.collect() if holds(need, {g for line in (r["text"] or "").split("\n") for g in trigrams(fold(line).encode())})}
    assert {r["path"] for r in index.candidates(need).collect()} == want and len(want) < files.count() and len(asked_trigrams(need)) == 3
