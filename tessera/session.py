"""The session, and the options of the engine."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


def session(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution; partition counts come from the cluster unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


@dataclass(frozen=True)
class RetrievalOptions:
    """Options of indexing and search, with the defaults of the service."""

    enabled: bool = True
    chunk_size: int = 60
    chunk_overlap: int = 10
    search_results: int = 5
    min_similarity: float = 0.25
    hybrid_weight_vector: float = 0.7
    hybrid_weight_bm25: float = 0.3
    max_chunks_per_file: int = 200
    mmr_lambda: float = 0.7
    candidate_factor: int = 12
    pool_factor: int = 8

    @classmethod
    def from_toml(cls, path: str) -> RetrievalOptions:
        """The [rag] table of a TOML file; absent keys keep their defaults, unknown ones are ignored."""
        with open(path, "rb") as file:
            given = tomllib.load(file).get("rag", {})
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})
