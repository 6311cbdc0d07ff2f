"""The chunk store: a Parquet table partitioned by domain, replaced as a whole version at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.code_chunker import code_chunks
from ..operators.chunking import cap_per_file, line_windows, not_blank, text_windows, with_search_columns
from ..operators.vector import check_vectors
from ..session import RetrievalOptions
from . import files as S

SCHEMA = "chunk_id long, source string, text string, kind string, file string, vector array<float>, domain string"
COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunks of files that come in, by domain and file, take the place of those stored."""
    keys = incoming.select("domain", "file").distinct()
    return stored.join(keys, ["domain", "file"], "left_anti").unionByName(incoming)


def clear(stored: DataFrame, domain: str | None = None) -> DataFrame:
    """Without one domain; without any chunk for anything else."""
    return stored.where(F.col("domain") != domain) if domain in ("code", "text") else stored.limit(0)


def domain_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("domain").agg(F.count("*").alias("chunks"))


def indexed_files(listed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Listed files that still have a chunk."""
    return listed.join(chunks.select("file").distinct(), "file", "left_semi")


class ChunkStore:
    """Versions of the table below a path; readers follow the last one that was finished.

    A version is a folder that Spark's committer completes; the list of versions is read from its names,
    so a failed write is never seen.
    """

    def __init__(self, spark: SparkSession, path: str, options: RetrievalOptions = RetrievalOptions()):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        if not self.fs.exists(self.fs_path(self.path)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.fs_path(self.path))]
        return sorted(n for n in names if n.startswith("v") and self.fs.exists(self.fs_path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        last = self._versions()[-1:]
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{last[0]}") if last else self.spark.createDataFrame([], SCHEMA)

    def chunks(self) -> DataFrame:
        return with_search_columns(self.read())

    def _write(self, rows: DataFrame) -> None:
        old = self._versions()
        number = int(old[-1][1:9]) + 1 if old else 1
        rows.select(*COLUMNS).write.partitionBy("domain").parquet(f"{self.path}/v{number:08d}-{uuid.uuid4().hex[:8]}")
        for name in old[:-1]:  # the last but one stays for readers that have begun
            self.fs.delete(self.fs_path(f"{self.path}/{name}"), True)

    def put(self, incoming: DataFrame) -> int:
        """Upserts chunks with vectors; returns how many came.  What comes is computed once, into a folder of its own."""
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        try:
            incoming.select(*COLUMNS).write.parquet(staged)
            incoming = self.spark.read.schema(SCHEMA).parquet(staged)
            stored = self.read()
            held = stored.select(F.size("vector")).limit(1).collect()
            check_vectors(incoming, held[0][0] if held else None)
            self._write(upsert(stored, incoming))
            return incoming.count()
        finally:
            self.fs.delete(self.fs_path(staged), True)

    def index(self, files: DataFrame, embed, domain: str = "code") -> dict:
        """Chunks files (name, content), embeds and stores them; embed(chunks) adds `vector`.

        Code is cut by its syntax; files that this leaves without a chunk get line windows.
        """
        domain, cut = "text" if domain == "text" else "code", None
        if domain == "text":
            made = text_windows(files)
        else:
            cut = code_chunks(files.select("name", "content", F.lit("").alias("language"))).select("file", "seq", "source", "text", "kind").persist()
            rest = files.join(cut.select(F.col("file").alias("name")).distinct(), "name", "left_anti")
            made = cut.unionByName(line_windows(rest, self.options.chunk_size, self.options.chunk_overlap))
        made = cap_per_file(not_blank(made), self.options.max_chunks_per_file)
        n = self.put(embed(made).withColumns({"domain": F.lit(domain), "chunk_id": F.xxhash64(F.lit(domain), "file", "seq")}))
        if cut is not None:
            cut.unpersist()
        return {"chunks_indexed": n, "domain_total": self.read().where(F.col("domain") == domain).count(), "files": files.select("name").distinct().count()}

    def index_path(self, root: str, embed) -> dict:
        """Indexes the files below a path, each in its own domain."""
        found = S.path_index(self.spark, root).cache()
        good = found.where("status = 'ok' and trim(content) <> ''")
        out = {"files_indexed": good.count(), "skipped": found.where("status <> 'ok'").count(), "chunks_indexed": 0}
        for domain in ("code", "text"):
            part = good.where(F.col("domain") == domain).select("name", "content")
            if part.limit(1).count():
                out["chunks_indexed"] += self.index(part, embed, domain)["chunks_indexed"]
        totals = {r["domain"]: r["chunks"] for r in domain_counts(self.read()).collect()}
        found.unpersist()
        return out | {"code_total": totals.get("code", 0), "text_total": totals.get("text", 0)}

    def clear(self, domain: str | None = None) -> None:
        left = clear(self.read(), domain)
        if left.limit(1).count():
            self._write(left)
        elif self.fs.exists(self.fs_path(self.path)):
            self.fs.delete(self.fs_path(self.path), True)

    def status(self) -> dict:
        rows = self.read()
        totals = {r["domain"]: r["chunks"] for r in domain_counts(rows).collect()}
        dim = rows.agg(F.max(F.size("vector"))).first()[0]
        return {
            "enabled": self.options.enabled, "chunks": sum(totals.values()), "chunks_code": totals.get("code", 0), "chunks_text": totals.get("text", 0), "vector_dim": dim or 0,
            "files": rows.select("file").distinct().count(), "weights": [self.options.hybrid_weight_vector, self.options.hybrid_weight_bm25],
        }
