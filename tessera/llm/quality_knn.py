"""Quality by nearest-neighbour voting in a latent semantic space (operator 1).

Features of a text are counts of its words' shapes (case, digits, punctuation; runs shortened), pairs of
neighbouring shapes, words equal to the one before, and words that close a repeated 5-gram, hashed to
`FEATURES` columns.  On a bounded sample of labelled documents they are weighted by tf-idf and reduced by
a truncated singular value decomposition, in one task; the sample's latent unit vectors and labels, a MB by the
parameters `most_labelled` and `rank`, are all that the driver gets, and are broadcast.  Every document is then placed in the same space,
its exact cosines with all labelled vectors are computed block by block, and its `neighbours` nearest
vote with weights that grow with their similarity.

The sample is fixed by a hash of the document id, so it doesn't depend on partitioning.  One pass over
the documents scores them; there is no shuffle of texts.

Defined results: texts without words (null, empty) get the sample's share of label 1; with no usable
labels every score is 0.5.  A document labelled twice counts as good if one label says so.  Labels of
documents that don't exist, or null, are ignored.  Repeated rows get equal scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import N1, R1, Words, as_bytes, col, in_doc, longs, mix, repeated, slices

FEATURES = 2048
BLOCK_ROWS = 512

#: Byte classes of word shapes: letters fold to A or a, digits to 0, the rest stands for itself.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[0x41:0x5B], CLASS[0x61:0x7B], CLASS[0x80:], CLASS[0x30:0x3A] = 0x41, 0x61, 0x61, 0x30


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """float32 [documents, FEATURES]: square roots of each shape's share of its document, not weighted yet."""
    n = len(at) - 1
    words = Words(raw, at)
    out = np.zeros((n, FEATURES), np.float32)
    if not len(words):
        return out
    doc = words.doc()
    kinds = CLASS[raw]
    fresh = np.ones(len(raw), bool)
    fresh[1:] = kinds[1:] != kinds[:-1]
    fresh[words.start] = True
    upto = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(fresh, out=upto[1:])
    shape = R1.spans(R1.sums(kinds[fresh]), upto[words.start], upto[words.end])
    half = np.uint64(FEATURES // 2)
    columns = [(shape % half).astype(np.int64)]
    pair = mix(shape[:-1] * np.uint64(3) + shape[1:])
    same = doc[1:] == doc[:-1]
    columns.append(np.where(same, (pair % (half - np.uint64(2)) + half).astype(np.int64), FEATURES - 3))
    hashes = words.hashes()
    again = (hashes[1:] == hashes[:-1]) & same
    owners = [doc, doc[1:], doc[1:][again]]
    columns.append(np.full(int(again.sum()), FEATURES - 2))
    fits = words.fits(5)
    if len(fits):
        which = np.flatnonzero(fits)
        twice = which[repeated(in_doc(N1.windows(N1.sums(hashes), 5)[which], doc[which]))]
        owners.append(doc[twice])
        columns.append(np.full(len(twice), FEATURES - 1))
    counts = np.bincount(np.concatenate(owners) * FEATURES + np.concatenate(columns), minlength=n * FEATURES).reshape(n, FEATURES)
    # shares of the document, so that length as such is no signal
    counts = counts / np.maximum(np.diff(words.first), 1)[:, None]
    return np.sqrt(counts, dtype=np.float32, out=out)


class Space:
    """The latent space, with labelled vectors in it."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int, neighbours: int, power: float):
        self.neighbours, self.power = min(neighbours, len(labels)), power
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if not len(labels):
            return
        held = (x > 0).sum(0)
        self.weight = (np.log((1 + len(x)) / (1 + held)) + 1).astype(np.float32)
        x = x * self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, : min(rank, len(labels))], np.float32)
        self.vectors = self._unit(x @ self.axes)

    @staticmethod
    def _unit(y: np.ndarray) -> np.ndarray:
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(self.labels):
            return out
        for lo in range(0, len(x), BLOCK_ROWS):
            part = x[lo : lo + BLOCK_ROWS]
            near = self._unit((part * self.weight) @ self.axes) @ self.vectors.T
            k = self.neighbours
            top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.broadcast_to(np.arange(k), near.shape)
            weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** self.power
            total = weight.sum(1)
            some = (total > 0) & part.any(1)
            out[lo : lo + BLOCK_ROWS][some] = (weight * self.labels[top]).sum(1)[some] / total[some]
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, rank: int = 48, neighbours: int = 15, power: float = 4.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space:
    """Learns from at most `most_labelled` rows of labels (id, 0/1), the first by a hash of the id."""
    asked = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(most_labelled)
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            x = features(*as_bytes(col(part, "_text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([col(part, "_id"), col(part, "_y").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["_id", "_y", "x"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(asked), "_id").select("_id", "_text", F.col("_y").cast("int").alias("_y"))
    kind = picked.schema["_id"].dataType.simpleString()
    # a document's rows may repeat, so the sample is bounded once more, by its fixed order
    sample = picked.mapInArrow(work, f"_id {kind}, _y int, x binary").orderBy(F.xxhash64("_id"), "_id", "x").limit(most_labelled).select("_y", "x")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            x = np.frombuffer(b"".join(v for b in held for v in col(b, "x").to_pylist()), np.float16).reshape(-1, FEATURES).astype(np.float32)
            space = Space(x, np.concatenate([longs(b, "_y") for b in held]) >= 1, rank, neighbours, power)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(space)])], ["space"])

    # the features and what the decomposition needs beside them, some 200 MB, stay in the task
    found = sample.mapInArrow(learn, "space binary").first()
    return pickle.loads(found.space) if found else Space(np.zeros((0, FEATURES), np.float32), np.zeros(0, bool), rank, neighbours, power)


def knn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fitting) -> DataFrame:
    """One row per row of docs: id, score (0 to 1; higher: label 1 is likelier), predicted (1 if score >= 0.5)."""
    space = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **fitting))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1 << 20):
            score = space.value.score(features(*as_bytes(col(part, "_text"))))
            yield pa.RecordBatch.from_arrays([col(part, "_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return picked.mapInArrow(work, f"`{id_col}` {picked.schema['_id'].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fitting) -> DataFrame:
    """The rows of docs, all columns, whose score is at least 0.5."""
    space = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **fitting))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 1 << 20):
            yield part.filter(pa.array(space.value.score(features(*as_bytes(col(part, text_col)))) >= 0.5))

    return docs.mapInArrow(work, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Documents whose labels are kept from learning: crc32 of the id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
