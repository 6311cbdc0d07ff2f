"""Projections over names, texts and tool calls: Column in, Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def lookup(key: Column, table: dict, default) -> Column:
    """A literal map, with a default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def extension(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def ext_lang(name: Column) -> Column:
    return lookup(F.lower(extension(name)), T.EXT_LANG, "text")


def lang_domain(lang: Column) -> Column:
    return F.when(lang.isin(T.TEXT_LANGS), "text").otherwise("code")


def lang_display_name(name: Column) -> Column:
    return lookup(extension(name), T.EXT_DISPLAY, "Text")


def detect_language(name: Column, given: Column) -> Column:
    """What was given, unless that is empty, auto or unknown; else by the extension."""
    g = F.lower(given)
    return F.when(given.isNotNull() & ~g.isin("", "auto", "unknown"), g).otherwise(F.when(F.contains(name, F.lit(".")), ext_lang(name)).otherwise("text"))


def contains_any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def content_tags(text: Column, tags=T.LINE_TAGS) -> Column:
    found = F.array_compact(F.array(*[F.when(contains_any(text, marks), F.lit(tag)) for tag, marks in tags]))
    return F.when(F.size(found) == 0, F.lit("code")).otherwise(F.array_join(found, ", "))


def metadata_header(file: Column, text: Column, first: Column, last: Column) -> Column:
    return F.concat(F.format_string("File: %s | Language: %s | Lines: %d-%d | Contains: %s\n", file, lang_display_name(file), first, last, content_tags(text)), text)


def chars_per_token(lang: Column) -> Column:
    return lookup(lang, T.CHARS_PER_TOKEN, T.DEFAULT_CHARS_PER_TOKEN)


def estimate_tokens(text: Column, lang: Column | None = None) -> Column:
    """Bytes over the language's ratio, rounded up."""
    ratio = F.lit(T.DEFAULT_CHARS_PER_TOKEN) if lang is None else chars_per_token(lang)
    return F.ceil(F.octet_length(text) / ratio).cast("long")


def estimate_tokens_utf16(text: Column) -> Column:
    """The client's estimate: UTF-16 units over 3.2, rounded up."""
    return F.ceil(F.octet_length(F.encode(text, "UTF-16BE")) / 2 / F.lit(3.2)).cast("long")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lines(text: Column) -> Column:
    """Lines ended by LF or CRLF; what follows the last end is a line unless it is empty."""
    parts = F.split(text, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def neutralize(text: Column, marks: list[str]) -> Column:
    for m in marks:
        text = F.replace(text, F.lit(m), F.lit(m[0] + "​" + m[1:]))
    return text


def sanitize_specials(text: Column) -> Column:
    """A zero-width space after the first character of every control string; applying it twice changes nothing more."""
    return neutralize(text, T.SPECIAL_STRINGS)


def sanitize_separators(text: Column) -> Column:
    """The same for role separators only."""
    return neutralize(text, [m for m in T.SPECIAL_STRINGS if m.startswith("<|") or m.endswith("_of_turn>")])


def looks_like_tool_attempt(text: Column) -> Column:
    plain = contains_any(text, ['"arguments"', '"parameters"', "<tool_call>", "<function=", *(f"<{t}" for t in T.TOOL_NAMES)])
    return plain | (F.contains(text, F.lit('"name"')) & contains_any(text, [f'"{t}"' for t in T.TOOL_NAMES]))


def first_line(text: Column, most: int) -> Column:
    """The first line that isn't blank or [stderr], cut to `most` characters."""
    line = F.coalesce(F.get(F.filter(lines(text), lambda x: ~F.trim(x).isin("", "[stderr]")), F.lit(0)), F.lit(""))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def summarize_call(name: Column, args: Column) -> Column:
    """The tool's name and its telling argument: the first of these that is a string."""
    v = F.try_parse_json(args)
    strings = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string")) for k in ("command", "file_path", "pattern", "query", "code", "path", "name")]
    detail = F.coalesce(*strings, F.lit(""))
    return F.when(detail == "", name).otherwise(F.concat(name, F.lit(" `"), first_line(detail, 60), F.lit("`")))


def normalize_args(call: Column) -> Column:
    """Arguments of a tool call as JSON text: under arguments, parameters, params or args (as an object, or as a
    string of JSON), else beside the name; null where the string isn't JSON."""
    whole = F.from_json(call, "map<string,variant>")
    text = F.from_json(call, "map<string,string>")  # strings without their quotes, the rest as JSON
    keys = ("arguments", "parameters", "params", "args")
    flat = F.to_json(F.map_filter(whole, lambda k, _: k != "name"))
    out = flat
    for k in reversed(keys):
        out = F.when(F.map_contains_key(text, k), F.to_json(F.try_parse_json(F.try_element_at(text, F.lit(k))))).otherwise(out)
    return out


def sanitize_name(name: Column) -> Column:
    return F.left(F.regexp_replace(name, "[^A-Za-z0-9_-]", ""), F.lit(64))


def arg_str(args: Column, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(args, f"$['{n}']") for n in names])


def arg_long(args: Column, *names: str) -> Column:
    """A whole number, also where it was sent as text."""
    return F.coalesce(*[F.get_json_object(args, f"$['{n}']").try_cast("long") for n in names])


def arg_bool(args: Column, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(args, f"$['{n}']").try_cast("boolean") for n in names])


def content_hash(text: Column) -> Column:
    """For noticing changes; its value has no other meaning."""
    return F.xxhash64(text)


def human_size(n: Column, units: str = "KMG") -> Column:
    """Bytes with the largest of the units that they reach; the last one takes all that is larger."""

    def unit(power: int) -> Column:
        return F.format_string("%.1f" + units[power - 1], F.bround(n.cast("double") / F.lit(float(1024**power)), 1))

    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
    for power in range(1, len(units)):
        out = out.when(n < 1024 ** (power + 1), unit(power))
    return out.otherwise(unit(len(units)))


def pretty_name(name: Column) -> Column:
    return F.translate(F.regexp_replace(name, r"(\.gguf)+$", ""), "-_", "  ")


def rel_path(root: str, path: Column) -> Column:
    root = root.rstrip("/")
    rel = F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30)).when(path == root, F.lit("")).otherwise(path)
    rel = F.translate(rel, "\\", "/")
    return F.when(rel == "", ".").otherwise(rel)


def prefix_at_boundary(text: Column, most: int | Column) -> Column:
    """The longest prefix of at most so many bytes that ends between characters."""
    most = F.lit(most).cast("int") if isinstance(most, int) else most.cast("int")
    raw = F.to_binary(text, F.lit("utf-8"))
    cuts = [F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(most - i, F.lit(0))).cast("string")) for i in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*cuts))


def prefix_at_line(text: Column, most: int | Column) -> Column:
    """The same, back to the end of its last whole line if it has one."""
    head = prefix_at_boundary(text, most)
    last = F.length(head) - F.instr(F.reverse(head), "\n") + 1
    return F.when(F.octet_length(head) == F.octet_length(text), text).when(F.contains(head, F.lit("\n")), F.substring(head, F.lit(1), last)).otherwise(head)


def truncate_to_tokens(text: Column, most: int) -> Column:
    """Text of more than `most` estimated tokens is cut to 3 bytes a token, which always fits, and marked."""
    return F.when(estimate_tokens(text) <= most, text).otherwise(F.concat(prefix_at_boundary(text, 3 * most), F.lit("\n[truncated: context budget]")))


def cap_output(text: Column, most: int = 8192) -> Column:
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(prefix_at_boundary(text, most), F.lit("\n[truncated]")))


def shown_span(output: Column) -> Column:
    """First and last line number of numbered output, as struct<a, b>, or null."""
    numbers = F.filter(F.transform(F.filter(lines(output), lambda x: F.contains(x, F.lit("\t"))), lambda x: F.trim(F.substring_index(x, "\t", 1)).try_cast("long")), lambda x: x.isNotNull())
    return F.when(F.size(numbers) > 0, F.struct(F.element_at(numbers, 1).alias("a"), F.element_at(numbers, -1).alias("b")))


def label_span(source: Column) -> Column:
    """The line span at the end of a chunk's label, as struct<a, b>, or null (split parts have none)."""
    tail = F.substring_index(source, ":", -1)
    a = F.trim(F.substring_index(tail, "-", 1)).try_cast("long")
    b = F.trim(F.substring(tail, F.instr(tail, "-") + 1, F.length(tail))).try_cast("long")
    return F.when(F.contains(tail, F.lit("-")) & a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def fmt_ranges(ranges: Column) -> Column:
    """An array of struct<a, b> as "1-3, 7"; a null bound is empty, as in "4-"."""

    def bound(x: Column) -> Column:
        return F.coalesce(x.cast("string"), F.lit(""))

    return F.array_join(F.transform(ranges, lambda r: F.when(r.a == r.b, r.a.cast("string")).otherwise(F.concat(bound(r.a), F.lit("-"), bound(r.b)))), ", ")


def parse_effort(tag: Column) -> Column:
    """struct<instruct, base> of an effort tag, or null."""
    t = F.lower(F.trim(tag))
    bare = F.substring(t, 2, 64)
    return F.when(F.startswith(t, F.lit("i")) & bare.isin(T.EFFORTS), F.struct(F.lit(True).alias("instruct"), bare.alias("base"))).when(
        t.isin(T.EFFORTS), F.struct(F.lit(False).alias("instruct"), t.alias("base"))
    )


def effort_rank(base: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, T.EFFORTS)), base)
    return F.when(at > 0, at - 1).otherwise(len(T.EFFORTS) - 1)


def clamp_effort(tag: Column, ceiling: Column) -> Column:
    """The tag, no stronger than the ceiling; empty for an unknown tag."""
    p = parse_effort(tag)
    base = F.when(effort_rank(p.base) > effort_rank(ceiling), ceiling).otherwise(p.base)
    return F.when(p.isNull(), "").otherwise(F.concat(F.when(p.instruct, "i").otherwise(""), base))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fenced_parts(text: Column) -> Column:
    """Text cut at ``` fences; every second part is code."""
    return F.split(text, "```")
