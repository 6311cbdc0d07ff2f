"""Glob and grep with a ladder of ever wider attempts, and paged reading."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .text_index import GrepIndex, required

MOST_WIDENINGS, GLOB_LIMIT, GREP_LIMIT, MOST_CONTEXT, PAGE_LINES, PAGE_BYTES = 3, 200, 250, 10, 2000, 8192
GLOB_PART = re.compile(r"\*\*/|\*\*|\*|\?|\{|\}|,|[^*?{},]+")
# What each part of a glob means as a regular expression.
GLOB_MEANS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(", "}": ")", ",": "|"}


def glob_regex(pattern: str, ignore_case: bool = False) -> str:
    """The regular expression of a glob; a comma is an alternative wherever it stands."""
    parts = (GLOB_MEANS.get(p) or re.sub(r"([^\w\s/])", r"\\\1", p) for p in GLOB_PART.findall(pattern))
    out = "^" + "".join(parts) + "$"
    re.compile(out)
    return ("(?i)" if ignore_case else "") + "(?s)" + out


def glob_match(path: Column, pattern: str, ignore_case: bool = False) -> Column:
    """On the path or on its last part."""
    rx = glob_regex(pattern, ignore_case)
    return path.rlike(rx) | F.substring_index(path, "/", -1).rlike(rx)


def glob_rungs(pattern: str) -> list[tuple[str, str, bool]]:
    """(what was relaxed, pattern, ignore case), narrowest first."""
    rungs = [("", pattern, False)]
    if pattern.lower() != pattern.upper():
        rungs.append(("ignoring case", pattern, True))
    loose = f"*{pattern.strip('*')}*"
    if loose != pattern:
        rungs.append((f"with `{loose}`, matching the name anywhere", loose, True))
    return rungs[: MOST_WIDENINGS + 1]


def glob_files(files: DataFrame, pattern: str, limit: int = GLOB_LIMIT) -> DataFrame:
    """path, mtime -> path, mtime, rung, relaxed: matches of the narrowest rung that has any, newest first.

    One pass marks each path with the first rung that it matches; the least rung of all wins (rungs only widen).
    """
    rungs = glob_rungs(pattern)
    first = F.coalesce(*[F.when(glob_match(F.col("path"), p, ci), F.lit(i)) for i, (_, p, ci) in enumerate(rungs)])
    marked = files.select("path", "mtime", first.alias("rung")).where("rung is not null")
    least = marked.agg(F.min("rung")).first()[0]
    if least is None:
        return marked.withColumn("relaxed", F.lit("")).limit(0)
    return marked.where(F.col("rung") <= least).withColumn("relaxed", F.lit(rungs[least][0])).orderBy(F.desc("mtime"), "path").limit(limit)


def reject_unsupported(pattern: str) -> None:
    """Look-around and back-references aren't part of the search language."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?P=", pattern):
        raise ValueError(f"`{pattern}` is not a valid regular expression: look-around and back-references are not supported")
    re.compile(pattern)


def grep_lines(files: DataFrame, condition: Column) -> DataFrame:
    """path, line_no, line, hit for every line of files (path, text)."""
    flat = files.select("path", F.posexplode(X.lines(F.col("text"))).alias("at", "line"))
    return flat.select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line", condition.alias("hit"))


def grep_rungs(pattern: str, glob: str | None, scope: str | None, ignore_case: bool) -> list[tuple[str, str, str | None, str | None]]:
    """(what was relaxed, regex, glob, scope): the call, then without its glob, its directory, its case."""
    rx = ("(?i)" if ignore_case else "") + pattern
    rungs = [("", rx, glob, scope)]
    if glob:
        rungs.append((f"without the `glob` filter (`{glob}`)", rx, None, scope))
    if scope:
        rungs.append(("across the whole workspace", rx, None, None))
    if not ignore_case:
        rungs.append(("ignoring case", "(?i)" + pattern, None, None))
    return rungs[: MOST_WIDENINGS + 1]


def narrowed(files: DataFrame, pattern: str, index: GrepIndex | None) -> DataFrame:
    """The files (path, text) that may hold a match; case makes no difference here."""
    need = True if index is None else required(pattern)
    return files if need is True else files.join(index.candidates(need), "path", "left_semi")


def grep(files: DataFrame, pattern: str, glob: str | None = None, scope: str | None = None, ignore_case: bool = False, mode: str = "content", context: int = 0, limit: int = GREP_LIMIT, index: GrepIndex | None = None, scanned: Observation | None = None) -> DataFrame:
    """Search of files (path, text), by the narrowest rung with a match.

    mode content: path, line_no, mark (":" for a match, "-" for context, "--" between regions), line;
    files_with_matches: path; count: path, n.  All have rung and relaxed.  With an index of the files, only those are
    read that hold the trigrams which the pattern requires; a pattern that requires none reads all.  `scanned` gets
    scanned_files, how many were read.
    """
    reject_unsupported(pattern)
    files = narrowed(files, pattern, index)
    every = files.observe(scanned, F.count(F.lit(1)).alias("scanned_files")) if scanned else files
    rungs = grep_rungs(pattern, glob, scope, ignore_case)

    def on_file(g: str | None, s: str | None) -> Column:
        ok = F.lit(True)
        if g:
            ok = ok & glob_match(F.col("path"), g)
        if s:
            ok = ok & F.startswith("path", F.lit(s.rstrip("/") + "/"))
        return ok

    # one pass: how many lines each rung finds
    counts = grep_lines(every, F.array(*[F.lit(0)])).select(
        *[F.count_if(F.col("line").rlike(rx) & on_file(g, s)).alias(f"r{i}") for i, (_, rx, g, s) in enumerate(rungs)]
    ).first()
    rung = next((i for i, n in enumerate(counts) if n), None)
    relaxed, rx, g, s = rungs[rung or 0]
    lines = grep_lines(files.where(on_file(g, s)) if rung is not None else files.limit(0), F.col("line").rlike(rx))
    lines = lines.withColumns({"rung": F.lit(rung).cast("int"), "relaxed": F.lit(relaxed)})
    if mode == "count":
        return lines.where("hit").groupBy("path", "rung", "relaxed").agg(F.count("*").alias("n")).orderBy("path").limit(limit)
    if mode in ("files_with_matches", "files"):
        return lines.where("hit").select("path", "rung", "relaxed").distinct().orderBy("path").limit(limit)
    return with_context(lines, min(context, MOST_CONTEXT)).orderBy("path", "line_no", F.when(F.col("mark") == "--", 0).otherwise(1)).limit(limit)


def with_context(lines: DataFrame, context: int) -> DataFrame:
    """Matches and `context` lines around them, and a row "--" before each region but a file's first."""
    around = Window.partitionBy("path").orderBy("line_no").rowsBetween(-context, context)
    shown = lines.withColumn("_near", F.max(F.col("hit").cast("int")).over(around)).where("_near = 1")
    before = F.lag("line_no").over(Window.partitionBy("path").orderBy("line_no"))
    marked = shown.withColumns({"mark": F.when(F.col("hit"), ":").otherwise("-"), "_gap": before < F.col("line_no") - 1})
    marks = F.when(F.col("_gap"), F.array(F.struct(F.lit("--").alias("mark"), F.lit("").alias("line")), F.struct("mark", "line"))).otherwise(F.array(F.struct("mark", "line")))
    return marked.withColumn("_rows", marks).drop("mark", "line", "hit", "_near", "_gap").withColumn("_r", F.explode("_rows")).select("path", "line_no", F.col("_r.mark").alias("mark"), F.col("_r.line").alias("line"), "rung", "relaxed")


def note_widening(relaxed: str, body: str) -> str:
    """What a widened result is prefixed with."""
    note = "[SUCCESS — results below. They come from retrying {}, because the call exactly as you wrote it matched nothing. Do not repeat that call; use these results.]\n"
    return note.format(relaxed) + body if relaxed else body


def read_page(files: DataFrame, offset: int = 1, limit: int = PAGE_LINES, most_bytes: int = PAGE_BYTES) -> DataFrame:
    """path, text -> path, first, last, total, body (numbered lines), footer: a page of whole lines within the byte cap;
    the first line is always shown.  Files shorter than the offset give no row."""
    offset = max(1, offset)
    flat = grep_lines(files, F.lit(True)).withColumn("total", F.max("line_no").over(Window.partitionBy("path")))
    entry = F.concat(F.col("line_no").cast("string"), F.lit("\t"), F.col("line"), F.lit("\n"))
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    page = flat.where((F.col("line_no") >= offset) & (F.col("line_no") < offset + max(1, limit))).withColumn("entry", entry)
    page = page.withColumn("size", F.sum(F.octet_length("entry")).over(order)).where((F.col("size") <= most_bytes) | (F.col("line_no") == offset))
    out = page.groupBy("path", "total").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "entry"))), lambda x: x.entry), "").alias("body"))
    more = F.when(F.col("last") < F.col("total"), F.format_string(" — continue with offset=%d", F.col("last") + 1)).otherwise("")
    footer = F.when((F.col("last") < F.col("total")) | (F.col("first") > 1), F.concat(F.format_string("\n[showing lines %d-%d of %d", "first", "last", "total"), more, F.lit("]"))).otherwise("")
    return out.select("path", "first", "last", "total", "body", footer.alias("footer"))
