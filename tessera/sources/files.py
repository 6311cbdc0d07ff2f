"""Trees of files as tables: walk, admission, listing, guarded edits, small binary headers."""

from __future__ import annotations

import io
import json
import os
import struct
import subprocess
import tempfile
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X

SNIFF, MOST_FILE, MOST_FILES, MOST_UPLOAD, MOST_BODY, MOST_ENTRIES = 8192, 1 << 20, 2000, 2 << 20, 10 << 20, 400


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), length, mtime, content of every file below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    return found.select(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*/", "/"), "^" + base.replace(".", r"\.") + "/", "").alias("path"), F.col("modificationTime").alias("mtime"), "length", "content")


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def workspace_admits(path: Column) -> Column:
    """At most 16 folders deep, none of them hidden or skipped (in any case), a known extension or name."""
    name = F.lower(F.substring_index(path, "/", -1))
    ok = name.isin(T.WORKSPACE_FILES) | (F.contains(name, F.lit(".")) & F.substring_index(name, ".", -1).isin(T.WORKSPACE_EXTS))
    inside = ~F.exists(folders(path), lambda d: F.startswith(d, F.lit(".")) | F.lower(d).isin(T.WORKSPACE_SKIP))
    return ok & inside & (F.size(folders(path)) <= T.WORKSPACE_DEPTH)


def tool_admits(path: Column) -> Column:
    """The walk of the search tools: its own skip list (case matters), at most 24 folders deep."""
    return ~F.exists(folders(path), lambda d: F.startswith(d, F.lit(".")) | d.isin(T.TOOL_SKIP)) & (F.size(folders(path)) <= T.TOOL_DEPTH)


def git_paths(root: str) -> list[str] | None:
    """What git lists for a repository, tracked or not ignored; null where git can't say."""
    if not os.path.exists(os.path.join(root, ".git")):
        return None
    ran = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], capture_output=True)
    return [p for p in ran.stdout.decode("utf-8", "replace").split("\0") if p] if ran.returncode == 0 else None


def workspace_walk(spark: SparkSession, root: str) -> DataFrame:
    """path of the indexable files of a workspace: of a repository what git lists, else a walk."""
    listed = git_paths(root)
    if listed is not None:
        name = F.lower(F.substring_index("path", "/", -1))
        return spark.createDataFrame([(p,) for p in listed], "path string").where(name.isin(T.WORKSPACE_FILES) | (F.contains(name, F.lit(".")) & F.substring_index(name, ".", -1).isin(T.WORKSPACE_EXTS)))
    return read_tree(spark, root).select("path").where(workspace_admits(F.col("path")))


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, SNIFF), F.lit(b"\x00"))


def path_index(spark: SparkSession, root: str, most_files: int = MOST_FILES) -> DataFrame:
    """name, content, language, domain, status of the files below root; status is ok or why a file is left out whole."""
    found = read_tree(spark, root).where(tool_admits(F.col("path")))
    if found.select("path").limit(most_files + 1).count() > most_files:
        raise ValueError(f"more than {most_files} files below {root}")
    status = F.when(F.col("length") > MOST_FILE, "too large").when(is_binary(F.col("content")), "binary").when(~F.is_valid_utf8(F.col("content").cast("string")), "not utf-8").otherwise("ok")
    lang = X.ext_lang(F.substring_index("path", "/", -1))
    return found.select(F.col("path").alias("name"), F.when(status == "ok", F.col("content").cast("string")).alias("content"), lang.alias("language"), X.lang_domain(lang).alias("domain"), status.alias("status"))


def uploaded(spark: SparkSession, body: str) -> DataFrame:
    """name, content, language of an inline upload {"files": [...], "domain"?}; anything but text is code."""
    if len(body.encode()) > MOST_BODY:
        raise ValueError("the upload is too large")
    given = json.loads(body)
    domain = "text" if given.get("domain") == "text" else "code"
    rows = [(f["name"], f["content"], f.get("language", ""), domain) for f in given["files"]]
    return spark.createDataFrame(rows, "name string, content string, language string, domain string")


def uploadable(files: DataFrame) -> DataFrame:
    return files.where(F.octet_length("content") <= MOST_UPLOAD)


def list_dir(entries: DataFrame, show_all: bool = False, limit: int = MOST_ENTRIES) -> DataFrame:
    """name, is_dir, length -> line and n: folders, then files, each by name."""
    seen = entries.where(F.lit(show_all) | ~F.startswith("name", F.lit(".")))
    line = F.when(F.col("is_dir"), F.format_string("d %8s  %s/", F.lit(""), "name")).otherwise(F.format_string("- %8s  %s", X.human_size(F.col("length")), "name"))
    return seen.select("name", "is_dir", line.alias("line")).orderBy(F.desc("is_dir"), "line").limit(limit)


def entries_of(files: DataFrame, folder: str = "") -> DataFrame:
    """name, is_dir, length of what is directly in a folder, from relative paths."""
    base = folder.strip("/") + "/" if folder.strip("/.") else ""
    rest = files.where(F.startswith("path", F.lit(base))).withColumn("rest", F.substring("path", len(base) + 1, 1 << 30))
    deeper = F.contains("rest", F.lit("/"))
    return rest.groupBy(F.substring_index("rest", "/", 1).alias("name"), deeper.alias("is_dir")).agg(F.sum(F.when(~deeper, F.col("length")).otherwise(0)).alias("length"))


def browse(files: DataFrame, folder: str = "") -> DataFrame:
    """Folders only, sorted without regard to case."""
    return entries_of(files, folder).where("is_dir and not startswith(name, '.')").select("name").orderBy(F.lower("name"), "name")


def known_models(found: DataFrame, known: DataFrame, defaults: dict, exclude: list[str]) -> DataFrame:
    """filename -> filename, name, family and the columns of `defaults`: what is configured for a file, else defaults."""
    out = found.where(F.endswith("filename", F.lit(".gguf"))).join(known.withColumnRenamed("name", "given").withColumn("_known", F.lit(True)), "filename", "left")
    out = out.where(~F.lower("filename").isin([x.lower() for x in exclude])) if exclude else out
    name = F.when(F.coalesce("given", F.lit("")) == "", X.pretty_name(F.col("filename"))).otherwise(F.col("given"))
    values = [F.coalesce(F.col(k), F.lit(v)).alias(k) if k in out.columns else F.lit(v).alias(k) for k, v in defaults.items()]
    return out.select("filename", name.alias("name"), F.coalesce("family", F.lit("unknown")).alias("family"), *values).orderBy("filename")


def confine(root: str, path: str) -> str:
    """The real path, which must stay below root."""
    base = os.path.realpath(root)
    real = os.path.realpath(os.path.join(base, path))
    if real != base and not real.startswith(base + os.sep):
        raise PermissionError(f"{path} is outside the workspace")
    return real


def write_verified(path: str, content: str) -> None:
    """Through a file beside it that takes its name, then read back."""
    fd, beside = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8", newline="") as file:
        file.write(content)
    os.replace(beside, path)
    with open(path, encoding="utf-8", newline="") as file:
        if file.read() != content:
            raise OSError(f"{path} doesn't hold what was written")


def write_new(root: str, path: str, content: str) -> str:
    real = confine(root, path)
    if os.path.exists(real):
        raise FileExistsError(f"{path} exists; edit it instead")
    os.makedirs(os.path.dirname(real), exist_ok=True)
    write_verified(real, content)
    return real


def edit_file(root: str, path: str, old: str, new: str, replace_all: bool = False) -> int:
    """Replaces old, which must be there once unless replace_all; returns how often."""
    real = confine(root, path)
    with open(real, encoding="utf-8", newline="") as file:
        text = file.read()
    n = text.count(old) if old else 0
    if not n or old == new:
        raise ValueError("nothing to replace")
    if n > 1 and not replace_all:
        raise ValueError(f"found {n} times; give more context or replace all")
    write_verified(real, text.replace(old, new))
    return n


def edit_column(text: Column, old: str, new: str, replace_all: bool = False) -> Column:
    """The same over rows: struct<status, n, text>."""
    n = ((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("long")
    status = F.when(n == 0, "absent").when((n > 1) & F.lit(not replace_all), "ambiguous").otherwise("ok")
    return F.struct(status.alias("status"), n.alias("n"), F.when(status == "ok", F.replace(text, F.lit(old), F.lit(new))).otherwise(text).alias("text"))


def config(path: str) -> dict:
    with open(path, "rb") as file:
        return tomllib.load(file)


def write_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# Widths of scalars in the header, by type; 8 is a string, 9 an array.
SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<B", 10: "<Q", 11: "<q", 12: "<d"}


def block_count(head: bytes) -> int | None:
    """The *.block_count of a model file's header; null where there is none or the header is damaged."""
    file = io.BytesIO(head)

    def take(form: str):
        return struct.unpack(form, file.read(struct.calcsize(form)))[0]

    def text() -> str:
        size = take("<Q")
        data = file.read(size)
        if len(data) < size:
            raise EOFError
        return data.decode("utf-8", "replace")

    def value(kind: int):
        if kind == 8:
            return text() and None
        if kind == 9:
            inner, n = take("<I"), take("<Q")
            for _ in range(n):
                value(inner)
            return None
        got = take(SCALARS[kind])
        return got if kind in (0, 1, 4, 5, 7, 10, 11) else None

    try:
        if file.read(4) != b"GGUF":
            return None
        take("<I"), take("<Q")
        for _ in range(take("<Q")):
            key, kind = text(), take("<I")
            got = value(kind)
            if key.endswith(".block_count") and got and got > 0:
                return got
    except (struct.error, EOFError, KeyError):
        return None
    return None


def block_counts(files: DataFrame) -> DataFrame:
    """path, content (the first megabytes are enough) -> path, blocks."""
    @F.pandas_udf("long")
    def blocks(content: pd.Series) -> pd.Series:
        return content.map(block_count).astype("Int64")

    return files.select("path", blocks(F.substring("content", 1, 8 << 20)).alias("blocks"))


def free_vram(probe: DataFrame) -> DataFrame:
    """line "index, free MiB" -> the most that any device has free."""
    return probe.agg(F.max(F.trim(F.element_at(F.split("line", ","), -1)).try_cast("long")).alias("free_mib"))


def meminfo(probe: DataFrame) -> DataFrame:
    """line "Key:  n kB" -> key, kib."""
    return probe.select(F.regexp_extract("line", r"^(\w+):", 1).alias("key"), F.regexp_extract("line", r":\s*(\d+)", 1).try_cast("long").alias("kib"))
