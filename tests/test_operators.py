"""Intervals, budgets, search tools, chunkers, vectors, ranking, planning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import budget, chunking, code_chunker, intervals, planner, search_tools, vector
from tessera.plans import retrieval
from tessera.session import RetrievalOptions


def spans(spark, rows, key="k"):
    return spark.createDataFrame([(key, a, b) for a, b in rows], "key string, a long, b long")


def pairs(df):
    return sorted((r["a"], r["b"]) for r in df.collect())


@pytest.mark.parametrize("given, tolerance, merged", [
    ([(1, 100), (101, 200)], 0, [(1, 200)]), ([(50, 60), (1, 10)], 0, [(1, 10), (50, 60)]), ([(1, 50), (20, 30)], 0, [(1, 50)]), ([], 0, []),
    ([(1, 10), (13, 32), (34, 36), (38, 76), (79, 134), (137, 137)], 6, [(1, 137)]),
    ([(1, 10), (13, 32), (34, 36), (38, 76), (79, 134), (137, 137)], 0, [(1, 10), (13, 32), (34, 36), (38, 76), (79, 134), (137, 137)]),
])
def test_interval_merge(spark, given, tolerance, merged):
    assert pairs(intervals.merge(spans(spark, given), tolerance=tolerance)) == merged


@pytest.mark.parametrize("have, total, left", [([(1, 100)], 250, [(101, 250)]), ([(50, 100)], 200, [(1, 49), (101, 200)]), ([(1, 200)], 200, []), ([], 30, [(1, 30)])])
def test_interval_gaps(spark, have, total, left):
    assert pairs(intervals.gaps(spans(spark, have), spark.createDataFrame([("k", total)], "key string, total long"))) == left


def test_interval_cover(spark):
    asked = [(1, 50), (200, 300), (50, 250), (150, 160)]
    got = {(r["a"], r["b"]): r["covered"] for r in intervals.covers(spans(spark, [(1, 100), (200, 300)]), spans(spark, asked)).collect()}
    assert got == dict(zip(asked, (True, True, False, False), strict=True))
    assert not intervals.covers(spans(spark, []), spans(spark, [(1, 1)])).first()["covered"]


def evicted(rows, cap, need):
    """The loop that the closed form stands for."""
    rows = list(rows)
    while sum(r[2] for r in rows) + need > cap:
        newest = rows[-1][0]
        victim = next((g for g, *_ in rows if g != newest and not any(p for x, _, _, p in rows if x == g)), None)
        if victim is None:
            break
        rows = [r for r in rows if r[0] != victim]
    return sorted(r[1] for r in rows)


def test_eviction(spark):
    rng, convs = random.Random(3), {}
    convs[0] = ([(0, 0, 100, True), (1, 1, 50, False), (1, 2, 50, False), (2, 3, 50, False), (2, 4, 50, False), (3, 5, 50, True)], 300, 50)
    for c in range(1, 40):
        groups = sorted(rng.randint(1, 6) for _ in range(rng.randint(1, 12)))
        convs[c] = ([(g, i, rng.randint(1, 90), rng.random() < 0.15) for i, g in enumerate(groups)], 300, 50)
    rows = [(c, *r) for c, (x, _, _) in convs.items() for r in x]
    left = budget.evict_to_fit(spark.createDataFrame(rows, "conv_id long, grp long, turn long, tokens long, pinned boolean"), 300, 50).collect()
    for c, (x, cap, need) in convs.items():
        assert sorted(r["turn"] for r in left if r["conv_id"] == c) == evicted(x, cap, need)


def test_packing_by_budget(spark):
    hits = spark.createDataFrame([(1, 1, 500), (1, 2, 10), (2, 1, 10), (2, 2, 20), (2, 3, 80), (2, 4, 1)], "query_id long, rank long, cost long")
    assert sorted((r["query_id"], r["rank"]) for r in budget.prefix_pack(hits, 100, 10).collect()) == [(1, 1), (2, 1), (2, 2)]
    files = spark.createDataFrame([(1, 1, "a", "", "line\n" * 200), (2, 1, "b", "rust", "x"), (2, 2, "c", "", "y" * 9000)], "conv_id long, rank long, name string, language string, content string")
    got = {(r["conv_id"], r["name"]): r for r in budget.pinned_pack(files, 150).collect()}
    assert set(got) == {(1, "a"), (2, "b")} and got[1, "a"]["truncated"] and "(truncated)" in got[1, "a"]["piece"]


def test_globs(spark):
    assert search_tools.glob_regex("**/*.{rs,py}") == r"(?s)^(?:.*/)?[^/]*\.(rs|py)$"
    files = spark.createDataFrame([("config.toml", 1), ("src/a.rs", 3), ("src/deep/b.rs", 2)], "path string, mtime long")
    hit = lambda p: [(r["path"], r["rung"]) for r in search_tools.glob_files(files, p).collect()]
    assert hit("**/*.rs") == [("src/a.rs", 0), ("src/deep/b.rs", 0)] and hit("config") == [("config.toml", 2)] and hit("A.RS") == [("src/a.rs", 1)] and hit("zzz") == []


def test_grep(spark):
    files = spark.createDataFrame([("lib.rs", "fn one() {}\nlet x = Two;\nend"), ("src/m.py", "two\n\n\nTwo\n")], "path string, text string")
    got = search_tools.grep(files, "Two", glob="*.go")
    assert [(r["path"], r["line_no"], r["rung"]) for r in got.where("mark = ':'").collect()] == [("lib.rs", 2, 1), ("src/m.py", 4, 1)] and "glob" in got.first()["relaxed"]
    assert {r["path"]: r["n"] for r in search_tools.grep(files, "TWO", mode="count").collect()} == {"lib.rs": 1, "src/m.py": 2}
    near = [(r["line_no"], r["mark"]) for r in search_tools.grep(files, "wo", scope="src", context=1).collect()]
    assert near == [(1, ":"), (2, "-"), (3, "-"), (4, ":")]
    assert search_tools.grep(files, "absent").count() == 0
    with pytest.raises(ValueError):
        search_tools.grep(files, r"(?=x)")


def test_read_page(spark):
    files = spark.createDataFrame([("f", "\n".join(f"l{i}" for i in range(1, 51)) + "\n"), ("g", "é" * 9000 + "\nx")], "path string, text string")
    got = {r["path"]: r for r in search_tools.read_page(files, 10, 5).collect()}
    assert got["f"]["body"] == "".join(f"{i}\tl{i}\n" for i in range(10, 15)) and "continue with offset=15" in got["f"]["footer"] and "g" not in got
    assert {r["path"]: r["last"] for r in search_tools.read_page(files).collect()} == {"f": 50, "g": 1}


def test_windows_of_words_and_lines(spark):
    for n in (0, 1, 180, 181, 330, 331, 500):
        rows = chunking.text_windows(spark.createDataFrame([("f", " ".join(f"w{i}" for i in range(n)))], "name string, content string")).orderBy("seq").collect()
        expected, start = [], 0
        while start < n:
            expected.append(" ".join(f"w{i}" for i in range(start, min(start + 180, n))))
            if start + 180 >= n:
                break
            start += 150
        assert [r["text"] for r in rows] == expected and [r["source"] for r in rows] == [f"f#{i}" for i in range(len(expected))]
    lines = spark.createDataFrame([("a.rs", "".join(f"l{i}\r\n" for i in range(130)))], "name string, content string")
    got = chunking.line_windows(lines).orderBy("seq").collect()
    assert [r["source"] for r in got] == ["a.rs:1-60", "a.rs:51-110", "a.rs:101-130"] and got[0]["text"].startswith("File: a.rs | Language: Rust | Lines: 1-60 | Contains: code\nl0\nl1")
    assert chunking.cap_per_file(chunking.line_windows(lines), 2).count() == 2 and chunking.cap_per_file(lines, 0) is lines


def vectors(spark, n, dim=16, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<float>").repartition(3)


def test_knn_is_exact_and_guards_hold(spark):
    x, chunks = vectors(spark, 300)
    extra = spark.createDataFrame([(900, [0.0] * 16), (901, [1.0, 2.0]), (902, None)], "chunk_id long, vector array<float>")
    queries = chunks.where("chunk_id < 4").withColumnRenamed("chunk_id", "query_id")
    got = vector.knn(queries, chunks.unionByName(extra), 300).collect()
    d = x.astype(float)
    cos = np.round(d @ d[:4].T / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d[:4], axis=1)), 6)
    for q in range(4):
        order = sorted(range(300), key=lambda i: (-cos[i, q], i))
        mine = [r for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert [r["chunk_id"] for r in mine if r["chunk_id"] < 300 and r["cos"] > 0] == [i for i in order if cos[i, q] > 0]
    a, b = F.array(*map(F.lit, [0.0, 0.0])), F.array(*map(F.lit, [1.0, 0.0]))
    assert spark.range(1).select(vector.cosine_distance(a, b), vector.cosine_distance(b, F.array(F.lit(1.0)))).first()[:] == (1.0, 1.0)
    with pytest.raises(ValueError):
        vector.check_vectors(chunks.unionByName(extra.where("chunk_id = 901")))


def test_inverted_file_recall(spark):
    _, chunks = vectors(spark, 2000, 16, 5)
    queries = chunks.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    index = vector.InvertedFile(chunks, cells=32, sample=1000)
    found = {(r["query_id"], r["chunk_id"]) for r in index.search(queries, 10, probes=16).collect()}
    exact = {(r["query_id"], r["chunk_id"]) for r in vector.knn(queries, chunks, 10).collect()}
    assert len(found & exact) / len(exact) >= 0.9 and index.table.count() == 2000


def model(queries, chunks, limit, domain, o):
    """Search as a plain program: one query at a time, over lists."""
    out = []
    n, stop = len(chunks), set(__import__("tessera.functions.tables", fromlist=["x"]).STOP_WORDS)
    mean = max(1.0, sum(len(c["text"].split()) for c in chunks) / n)

    def cos(a, b):
        return round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 6)

    import re

    for q in queries:
        near = sorted(((cos(q["vector"], c["vector"]), c) for c in chunks), key=lambda x: (-x[0], x[1]["chunk_id"]))[: 12 * limit]
        pool = [x for x in near if x[1]["domain"] == domain][: 8 * limit]
        terms = [t for t in (re.sub(r"^[\W]+|[\W]+$", "", p).lower() for p in re.split(r"[\s:.()]+", q["query_text"])) if t and t not in stop]
        scored = []
        for s, c in pool:
            low, raw = c["text"].lower(), 0.0
            for t in terms:
                df, tf = sum(t in x["text"].lower() for x in chunks), low.count(t)
                raw += np.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(c["text"].split()) / mean)) if tf else 0
            scored.append((round(0.7 * s + 0.3 * raw / (raw + 1), 6) if terms else s, c))
        left = [x for x in sorted(scored, key=lambda x: (-x[0], x[1]["chunk_id"])) if x[0] >= o.min_similarity]
        taken = [left.pop(0)] if left else []
        while left and len(taken) < limit:
            value = [round(0.7 * s - 0.3 * max(cos(c["vector"], t["vector"]) for _, t in taken), 9) for s, c in left]
            taken.append(left.pop(value.index(max(value))))
        final, chosen = [], {c["chunk_id"] for _, c in taken}
        for s, c in taken:
            if c["kind"] != "file_summary" or not c["file"]:
                final.append((c["chunk_id"], s))
                continue
            kids = sorted(((cos(q["vector"], k["vector"]), k["chunk_id"]) for k in chunks if k["file"] == c["file"] and k["kind"] != "file_summary" and k["chunk_id"] not in chosen), key=lambda x: (-x[0], x[1]))
            final += [(i, v) for v, i in kids[: min(3, max(0, limit - len(final)))] if v >= o.min_similarity]
        out += [(q["query_id"], r + 1, i, round(s, 6)) for r, (i, s) in enumerate(final[:limit])]
    return out


def test_search_equals_the_plain_program(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "parse_x", "the", "fn", "omega"]
    x = np.random.default_rng(3).normal(size=(90, 6)) + 0.6
    chunks = [{"chunk_id": i, "source": f"s{i}", "text": " ".join(rng.choices(words, k=rng.randint(3, 30))), "kind": "file_summary" if i % 9 == 0 else "block", "file": f"f{i // 9}", "domain": "code" if i % 3 else "text", "vector": [float(np.float32(v)) for v in x[i]]} for i in range(90)]
    queries = [{"query_id": j, "query_text": t, "vector": chunks[j * 7]["vector"]} for j, t in enumerate(["alpha: beta.gamma(delta)", "the fn", "omega omega parse_x", ""])]
    c = spark.createDataFrame(chunks, "chunk_id long, source string, text string, kind string, file string, domain string, vector array<float>")
    q = spark.createDataFrame(queries, "query_id long, query_text string, vector array<float>")
    o = RetrievalOptions()
    for domain in ("code", "text"):
        got = retrieval.search(q, c, 4, domain, o).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in got] == model(queries, chunks, 4, domain, o)
    merged = retrieval.retrieve(q, c, 4, o).collect()
    assert max(r["rank"] for r in merged) <= 4
    with pytest.raises(ValueError):
        retrieval.retrieve(q, c, 4, RetrievalOptions(enabled=False))
    # a domain can be starved by nearer rows of the other
    far = c.withColumn("domain", F.when(F.col("chunk_id") == 89, "text").otherwise("code"))
    assert retrieval.candidates(q, far, 1, "text", o).count() <= 4


RUST = "use std::fs;\n\n/// Doc.\n/// More.\npub fn add(\n    a: i32,\n) -> i32 {\n    helper_fn(a) // {\n}\n\nstruct P { x: i32 }\n\nimpl P {\n    fn norm(&self) -> f64 { compute(self.x) }\n\n    fn other(&self) {\n        let s = \"}\";\n    }\n}\n"


def test_scopes_of_braces():
    got = [(c["source"], c["parent_scope"]) for c in code_chunker.chunks_of("a.rs", RUST)]
    assert got == [("a.rs:function:add:3-9", ""), ("a.rs:struct:P:11-11", ""), ("a.rs:function:norm:14-14", "impl P"), ("a.rs:function:other:16-18", "impl P")]
    first = code_chunker.chunks_of("a.rs", RUST)[0]
    assert first["text"].startswith("File: a.rs | Language: Rust | Type: function | Block: add | Lines: 3-9 | Contains: functions | Refs: add, helper_fn\n/// Doc.")


def test_scopes_of_indents():
    text = "import os\nfrom sys import x\n\n\nclass A:\n    \"\"\"class doc\"\"\"\n\n    def f(self):\n        return go(1)\n\n\n@cached\n# note\ndef g(x):\n    return x\n\nprint(g(1))\n"
    got = [(c["source"], c["block_type"], c["parent_scope"]) for c in code_chunker.chunks_of("b.py", text)]
    # a line that is only a string counts as a comment, so a class's documentation goes to its first method
    assert got == [("b.py:class_header:A:5-5", "class_header", ""), ("b.py:function:f:6-9", "function", "class A"), ("b.py:function:g:12-15", "function", "")]


def test_known_quirks():
    assert code_chunker.chunks_of("x.sh", "f() {\n a\n b\n}\n")[0]["source"] == "x.sh:gap:<file>:1-5"  # no scopes for shells
    assert [c["source"] for c in code_chunker.chunks_of("x.rs", "const fn f() -> u8 {\n    1\n}\n")] == ["x.rs:constant:fn:1-3"]
    assert code_chunker.chunks_of("x.css", "a {\n  b: c;\n  d: e;\n}\n")[0]["block_type"] == "gap"
    assert code_chunker.chunks_of("x.txt", " \t") == [] and code_chunker.chunks_of("x.txt", "one\ntwo") == []


def test_summary_and_splits():
    body = "fn big() {\n" + "\n".join("" if i in (60, 61, 100) else "// ----- part" if i == 40 else f"    let v{i} = call_{i}({i});" for i in range(1, 159)) + "\n}\n"
    got = code_chunker.chunks_of("big.rs", body)
    assert got[0]["kind"] == "file_summary" and "Functions: big" in got[0]["text"]
    parts = [c for c in got if c["kind"] == "block_part"]
    assert [c["source"] for c in parts] == ["big.rs:function:big:1-160[1/2]", "big.rs:function:big:1-160[2/2]"] and "continues in part 2/2" in parts[0]["text"] and "part 1/2" in parts[1]["text"]
    assert code_chunker.split_at(["x"] * 400, 150) == [(0, 150), (150, 300), (300, 400)]
    assert code_chunker.split_at(["x"] * 60 + ["", ""] + ["x"] * 60 + ["}", ""] + ["x"] * 60, 150)[0] == (0, 60)
    assert code_chunker.imports(["use crate::a;", "use b::c;", "use crate::a;"], "rust") == ["a", "b"]


def test_chunker_as_table_and_function(spark):
    files = spark.createDataFrame([("a.rs", RUST, ""), ("n.md", None, None)], "name string, content string, language string")
    assert code_chunker.code_chunks(files).where("kind = 'block'").count() == 4
    code_chunker.register(spark)
    files.createOrReplaceTempView("sources")
    assert spark.sql("select c.source from sources s, lateral chunk_source(s.name, s.content, s.language) c where s.name = 'a.rs'").count() == 4
    assert len(code_chunker.fallback("f", "x\n" * 130)) == 3


def test_planner(spark):
    rows = [(1, 6512, 32, 7500, -1, 0), (2, 6512, 32, 6500, -1, 0), (3, 3000, 32, 8000, -1, 0), (4, 6000, 32, 4000, -1, 0), (5, 6000, None, 4000, -1, 0), (6, 6000, 32, None, -1, 4096)]
    m = spark.createDataFrame(rows, "model_id long, file_mib int, layers int, free_mib int, requested_ngl int, max_ctx int")
    got = {r["model_id"]: r for r in planner.plan_launch(m).collect()}
    for i in (1, 2):
        assert got[i]["ctx"] >= 8192 and got[i]["flash_attn"] and got[i]["cache_type"] == "q8_0"
    assert got[3]["ngl"] == -1 and got[4]["ctx"] >= 2048 and 0 < got[4]["ngl"] < 32 and got[5]["ngl"] == 0 and got[6]["ctx"] == 4096 and got[6]["cache_type"] == ""
    f = lambda *x: spark.range(1).select(planner.measured_factor(*map(F.lit, x))).first()[0]
    assert round(f(6016, 32, 6512, 32), 3) == 0.924 and f(400, 32, 6512, 32) is None and f(13000, 32, 6512, 32) is None and round(f(3008, 16, 6512, 32), 3) == 0.924


def test_similar_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 40 * 8)
    r = np.random.default_rng(9)
    middles = r.normal(size=(6, 8))
    x = (middles[r.integers(0, 6, 400)] + 0.15 * r.normal(size=(400, 8))).astype(np.float32)
    x[100:180] = x[7]  # more equal vectors than a block holds
    x[50] = 0
    odd = [(None, x[1].tolist()), (900, None), (901, []), (902, [1.0])]
    rows = [(int(i), v.tolist()) for i, v in zip(r.permutation(400), x, strict=True)] + odd
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, block int")
    keys, m = np.array([i for i, _ in rows[:400]]), np.array([v for _, v in rows[:400]], np.float64)
    for least in (0.6, 0.0, -0.5):
        cos = np.round(vector.cosines(m, m), 6)
        want = sorted((int(keys[i]), int(keys[j]), float(cos[i, j])) for i, j in zip(*np.nonzero(cos > least), strict=True) if keys[i] < keys[j])
        assert sorted((a, b, c) for a, b, c in vector.similar_pairs(df, least).collect()) == want
    blocks, count = vector.blocks_of(df.where("vec_id is not null"), "vec_id", "embedding", 8)
    sizes = [len(b["keys"]) for b in blocks.collect()]
    assert sum(sizes) == 400 and len(sizes) <= count and max(sizes) < 80 and sorted(b["block"] for b in blocks.collect())[-1] < count
    assert vector.similar_pairs(df.limit(0), 0.5).collect() == []
