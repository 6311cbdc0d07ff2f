"""Names, texts and tool calls."""

import json

from pyspark.sql import functions as F

from tessera.functions import tables as T
from tessera.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


def test_languages(spark):
    for name, lang in (("a/B.RS", "rust"), ("x.yml", "yaml"), ("Makefile", "text"), ("a.b.ts", "typescript"), (".env", "env")):
        assert one(spark, X.ext_lang(lit(name))) == lang
    assert one(spark, X.lang_domain(lit("ini"))) == "text" and one(spark, X.lang_domain(lit("rust"))) == "code"
    assert one(spark, X.detect_language(lit("a.py"), lit("AUTO"))) == "python" and one(spark, X.detect_language(lit("a.py"), lit("Go"))) == "go"
    assert one(spark, X.lang_display_name(lit("x.kts"))) == "Kotlin" and one(spark, X.lang_display_name(lit("x.RS"))) == "Text"


def test_tags_and_header(spark):
    assert one(spark, X.content_tags(lit("impl X { fn f() -> Result<u8> {} }"))) == "functions, impl, error_handling"
    assert one(spark, X.content_tags(lit("nothing"))) == "code"
    assert one(spark, X.metadata_header(lit("a.rs"), lit("use x;"), lit(1), lit(9))) == "File: a.rs | Language: Rust | Lines: 1-9 | Contains: imports\nuse x;"


def test_tokens(spark):
    assert one(spark, X.estimate_tokens(lit("é" * 13), lit("rust"))) == 10
    assert one(spark, X.estimate_tokens(lit(""))) == 0
    assert one(spark, X.estimate_tokens_utf16(lit("🙂" * 8))) == 5


def test_prefixes(spark):
    assert one(spark, X.prefix_at_boundary(lit("aé🙂b"), 6)) == "aé" and one(spark, X.prefix_at_boundary(lit("aé🙂b"), 7)) == "aé🙂"
    assert one(spark, X.prefix_at_boundary(lit("abc"), 3)) == "abc" and one(spark, X.prefix_at_boundary(lit("é"), 1)) == ""
    assert one(spark, X.prefix_at_line(lit("ab\ncd\nef"), 7)) == "ab\ncd\n" and one(spark, X.prefix_at_line(lit("abcdef"), 3)) == "abc"
    assert one(spark, X.truncate_to_tokens(lit("x" * 100), 10)) == "x" * 30 + "\n[truncated: context budget]"
    assert one(spark, X.cap_output(lit("é" * 5000))) == "é" * 4096 + "\n[truncated]"


def test_sanitizing(spark):
    text = "a <|im_start|>user <tool_call> <end_of_turn> </tool_response>"
    once = one(spark, X.sanitize_specials(lit(text)))
    assert once != text and once.replace("​", "") == text and one(spark, X.sanitize_specials(lit(once))) == once
    assert not any(m in once for m in T.SPECIAL_STRINGS)
    apart = one(spark, X.sanitize_separators(lit(text)))
    assert "<tool_call>" in apart and "<|im_start|>" not in apart and "<end_of_turn>" not in apart


def test_tool_attempts(spark):
    for text, hit in (('{"name": "read_file", "x": 1}', True), ("<grep_files>", True), ("I could use grep_files or read_file here", False), ('the "name" field', False)):
        assert one(spark, X.looks_like_tool_attempt(lit(text))) is hit


def test_call_summary_and_first_line(spark):
    assert one(spark, X.summarize_call(lit("run_bash"), lit('{"command": "ls -la"}'))) == "run_bash `ls -la`"
    assert one(spark, X.summarize_call(lit("run_bash"), lit("{}"))) == "run_bash"
    assert one(spark, X.summarize_call(lit("t"), lit('{"command": 5, "path": "p"}'))) == "t `p`"
    assert one(spark, X.first_line(lit("\n  \n[stderr]\nboom here"), 4)) == "boom…"


def test_normalized_arguments(spark):
    cases = [
        ({"name": "t", "arguments": {"command": "ls"}}, {"command": "ls"}),
        ({"name": "t", "command": "ls", "n": 3}, {"command": "ls", "n": 3}),
        ({"arguments": '{"command": "ls"}'}, {"command": "ls"}),
        ({"arguments": {"a": 1}, "command": "ls"}, {"a": 1}),
        ({"args": "not json"}, None),
        ({"params": {"x": [1, {"y": None}]}}, {"x": [1, {"y": None}]}),
    ]
    for given, expected in cases:
        got = one(spark, X.normalize_args(lit(json.dumps(given))))
        assert (json.loads(got) if got else None) == expected, given


def test_names_and_arguments(spark):
    assert one(spark, X.sanitize_name(lit("../../etc/passwd"))) == "etcpasswd" and one(spark, X.sanitize_name(lit("my_tool-2"))) == "my_tool-2"
    assert one(spark, X.arg_long(lit('{"limit": "12"}'), "count", "limit")) == 12
    assert one(spark, X.arg_bool(lit('{"-i": "true"}'), "i", "-i")) is True
    assert one(spark, X.human_size(lit(1536))) == "1.5K" and one(spark, X.human_size(lit(12))) == "12B"
    assert one(spark, X.rel_path("/w", lit("/w/a\\b"))) == "a/b" and one(spark, X.rel_path("/w", lit("/w"))) == "."


def test_spans(spark):
    assert tuple(one(spark, X.shown_span(lit("12\ta\n13\tb\n14\tc")))) == (12, 14) and one(spark, X.shown_span(lit("[file is empty]"))) is None
    assert tuple(one(spark, X.label_span(lit("a.rs:function:install:61-120")))) == (61, 120) and one(spark, X.label_span(lit("a.rs:f:1-9[1/2]"))) is None
    assert one(spark, X.fmt_ranges(F.array(F.struct(lit(1).alias("a"), lit(3).alias("b")), F.struct(lit(7).alias("a"), lit(7).alias("b"))))) == "1-3, 7"


def test_efforts(spark):
    for tag, known in (("xhigh", (False, "xhigh")), ("ixhigh", (True, "xhigh")), (" SPOON ", (False, "spoon")), ("ieinstein", (True, "einstein")), ("", None), ("xhgih", None), ("high", None)):
        got = one(spark, X.parse_effort(lit(tag)))
        assert (tuple(got) if got else None) == known
    assert one(spark, X.clamp_effort(lit("spoon"), lit("medium"))) == "medium" and one(spark, X.clamp_effort(lit("ispoon"), lit("medium"))) == "imedium" and one(spark, X.clamp_effort(lit("?"), lit("low"))) == ""
