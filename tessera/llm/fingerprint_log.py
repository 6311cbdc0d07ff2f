"""Substring deduplication over a log-structured fingerprint index (operator 6).

Fingerprints.  Of the word 12-grams in every 35 consecutive words, the one with the least hash stands
for the window (all of them where hashes tie), so equal windows have equal fingerprints and a document
has about one fingerprint for every twelve words (all window hashes would be about twelve times as many).

Log.  Documents come in batches, each in blocks.  The log holds sorted, immutable runs in two families: of the
fingerprints of all batches, and of the window hashes behind those fingerprints that were met twice.  An entry
says which block holds it, or that several places do.  For each batch
 1. its sorted fingerprints are merge-joined with the runs: what history, or the batch itself, holds as well is
    opened, in the batch's blocks and in the one earlier block that held it alone until now;
 2. of the opened fingerprints every window is hashed twice, by hashes that are independent from the words' bytes on
    (64 bits each); these are merge-joined with the runs of window hashes, which verifies them: a window that is
    there already, or twice in the batch, is a repeat, and so is the one that an earlier block held alone until now;
 3. fingerprints and window hashes become new runs; when `fan_out` runs of a family have gathered, they are compacted.
So texts of earlier batches are read only where they are hit, but a look-up reads and joins the runs of the whole log
with the batch, so its cost grows with the log's runs (about a twelfth of a hash a word); the verdicts on earlier
documents are brought up to date, as the query asks for a symmetric answer.  A log with a folder keeps its runs, blocks and
verdicts there, listed in numbered manifests, and later sessions go on with it.

Costs: a fingerprint that a third of all documents hold is one entry a block in a message, and one entry in the
index, so no task gets a hot group.  Nothing is collected on the driver.

Defined results: null and empty texts have no words and keep the hash of nothing; fewer than 35 words
have no window; repeated rows are windows of their own, so both lose what they share; rows with a null
id are kept whole and take no part; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, answer, bucket_count, joined, loosen, messages, send, squeeze, tidy, to_blocks
from .common import N1, N2, R2, Words, cover, cut, drop_path, member, mix, per_doc, slide_min, winnow, write

WINDOW, GRAM = 35, 12
#: Replies (block, keys) and run rows (bucket, keys, holders, checks) of a batch, in one table.
TAKEN = "bucket long, block long, keys binary, holders binary, checks binary"
#: Holder of what several places hold.
MANY = -1


def fingerprints(words: Words, sums: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the words' fingerprints."""
    grams = N1.windows(sums, gram)
    at = winnow(grams, window - gram + 1)
    at = at[words.fits(gram)[at]] if len(at) else at
    return at, mix(grams[at])  # minima are small numbers: mixed anew, they spread evenly over buckets


def grouped(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of entries by (key, check), and where each distinct one begins in it."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    if len(k) and ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, np.flatnonzero(fresh)


def union(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """One number for each pair of hashes, both of which bind it."""
    return mix(keys + mix(checks))


def distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries in order, and whether each comes twice or more."""
    order, first = grouped(keys, checks)
    return keys[order[first]], checks[order[first]], (np.diff(np.append(first, len(keys))) > 1).astype(np.uint8)


def entries(t: pa.Table, sent: bool, with_checks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, checks, holders of a bucket's messages or run rows, and offsets of the rows.

    Runs, and messages with `packed`, have their sorted keys as compressed differences.
    """
    tight = not sent or "packed" in t.column_names
    parts = [loosen(x.as_py(), rising=True) if tight else np.frombuffer(x.as_py(), np.uint64) for x in t.column("packed" if sent and tight else "keys")]
    at = np.cumsum([0, *map(len, parts)])
    keys = np.concatenate([np.zeros(0, np.uint64), *parts])
    checks = joined(t, "more1" if sent else "checks", np.uint64)[0] if with_checks else np.zeros(len(keys), np.uint64)
    if not sent:
        return keys, checks, np.concatenate([np.zeros(0, np.int64), *(loosen(x.as_py(), np.int64) for x in t.column("holders"))]), at
    blocks = np.repeat(t.column("block").to_numpy(), np.diff(at)) if t.num_rows else np.zeros(0, np.int64)
    return keys, checks, np.where(joined(t, "more0", np.uint8)[0] > 0, MANY, blocks), at


def tightened(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Messages whose sorted keys are compressed differences."""
    packed = pa.array([squeeze(np.frombuffer(x.as_py(), np.uint64), True) for x in batch.column("keys")], pa.binary())
    return pa.RecordBatch.from_arrays([packed if n == "keys" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], ["packed" if n == "keys" else n for n in batch.schema.names])


def keys_in(replies: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(loosen(x.as_py(), rising=True) for x in replies.column("keys"))])


def told(tables: list[DataFrame]) -> DataFrame:
    """The replies (block, keys) in some batches' tables."""
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out.where("kind = 'reply'").select("block", "keys")


class FingerprintLog:
    """Sorted immutable runs, by bucket, of the keys (and their checks) of all batches so far, with their holders.

    Batches are messages of blocks: bucket, block, keys, more0 (whether the block holds a key twice) and, with checks, more1.
    """

    def __init__(self, spark: SparkSession, fan_out: int = 4, checks: bool = False, write=cut):
        self.spark, self.fan_out, self.checks, self.write = spark, fan_out, checks, write
        self.runs: list[DataFrame] = []
        #: the tables whose replies count, and paths of runs that were compacted
        self.replies: list[DataFrame] = []
        self.stale: list[str] = []
        self.run: str = "bucket long, keys binary, holders binary" + ", checks binary" * checks

    def append(self, sent: DataFrame) -> None:
        """Adds a batch as a new run, and compacts if runs have gathered."""
        self.runs.append(self.write(self._merged(sent, True), "run"))
        if len(self.runs) >= self.fan_out:
            self.compact()

    def compact(self) -> None:
        if len(self.runs) > 1:
            old, self.runs = self.runs, [self.write(self._merged(self._all(), False), "run")]
            # replies that came with a run stay
            self.stale += [run._written_at + "/kind=run" * ("kind" in run.columns) for run in old]
            tidy(self.spark)

    def _all(self) -> DataFrame:
        columns = [x.split()[0] for x in self.run.split(", ")]
        out = self.spark.createDataFrame([], self.run)
        for i, run in enumerate(self.runs):
            part = (run.where("kind = 'run'") if "kind" in run.columns else run).select(columns)
            out = out.unionByName(part) if i else part
        return out

    def _merged(self, rows: DataFrame, sent: bool) -> DataFrame:
        with_checks = self.checks

        def work(t: pa.Table) -> pa.Table:
            keys, checks, holders, _ = entries(t, sent, with_checks)
            order, first = grouped(keys, checks)
            lone = np.diff(np.append(first, len(keys))) == 1
            arrays = [squeeze(keys[order[first]], True), squeeze(np.where(lone, holders[order[first]], MANY)), *[checks[order[first]].tobytes()] * with_checks]
            return pa.table([t.column("bucket").slice(0, 1), *(pa.array([x], pa.binary()) for x in arrays)], ["bucket", "keys", "holders", "checks"][: 1 + len(arrays)])

        return rows.groupBy("bucket").applyInArrow(work, self.run)

    def hits(self, sent: DataFrame, least: int = 1, late: bool = False) -> DataFrame:
        """Merge-joins messages with the runs; replies (block, keys), of keys with checks their union.

        least = 1: for a batch that isn't in the log yet, what the log or the batch holds elsewhere; 2: for one that is.
        With late also to earlier blocks, what they held alone until now.
        """
        return self._met(sent, least, late, False).select("block", "keys")

    def take(self, sent: DataFrame) -> DataFrame:
        """Looks a batch up and adds it as a new run, in one exchange; replies (block, keys), late ones too."""
        both = self.write(self._met(sent, 1, True, True).withColumn("kind", F.expr("if(bucket is null, 'reply', 'run')")), "run")
        self.runs.append(both)
        self.replies.append(both)
        if len(self.runs) >= self.fan_out:
            self.compact()
        return told([both])

    def _met(self, sent: DataFrame, least: int, late: bool, with_run: bool) -> DataFrame:
        with_checks = self.checks

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            k0, c0, h0, _ = entries(right, False, with_checks)
            k1, c1, h1, at = entries(left, True, with_checks)
            keys, checks, holders = np.concatenate([k0, k1]), np.concatenate([c0, c1]), np.concatenate([h0, h1])
            order, first = grouped(keys, checks)
            size = np.diff(np.append(first, len(keys)))
            old = order < len(k0)

            def count(x: np.ndarray) -> np.ndarray:
                """The sum over each distinct key, at all of its entries."""
                return np.repeat(np.add.reduceat(x.astype(np.int64), first), size) if len(first) else x

            again = np.zeros(len(keys), bool)
            again[order] = count((old if least == 2 else 1) * np.where(holders[order] == MANY, 2, 1)) > 1
            mine, said = again[len(k0) :], union(k1, c1) if with_checks else k1
            out = [(left.column("block")[i].as_py(), said[x][mine[x]]) for i in range(left.num_rows) for x in [slice(at[i], at[i + 1])] if mine[x].any()]
            if late and len(first):
                lone = np.sort(order[old & (count(old) == 1) & (count(~old) > 0)])
                lone = lone[h0[lone] != MANY]
                lone = lone[np.argsort(h0[lone], kind="stable")]
                blocks, starts = np.unique(h0[lone], return_index=True)
                said = union(k0, c0) if with_checks else k0
                out += [(b, said[x]) for b, x in zip(blocks.tolist(), np.split(lone, starts[1:]), strict=len(blocks) > 0)]
            nothing = [None] * len(out)
            columns = {"bucket": nothing, "block": [b for b, _ in out], "keys": [squeeze(np.sort(k), True) if with_run else k.tobytes() for _, k in out], "holders": nothing, "checks": nothing}
            if with_run and left.num_rows:
                order, first = grouped(k1, c1)
                lone = np.diff(np.append(first, len(k1))) == 1
                run = [left.column("bucket")[0].as_py(), None, squeeze(k1[order[first]], True), squeeze(np.where(lone, h1[order[first]], MANY)), c1[order[first]].tobytes() if with_checks else None]
                columns = {x: [*v, y] for (x, v), y in zip(columns.items(), run, strict=True)}
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.table({x: pa.array(v, kind) for (x, v), kind in zip(columns.items(), kinds, strict=True)})

        return sent.groupBy("bucket").cogroup(self._all().groupBy("bucket")).applyInArrow(work, TAKEN)


def kept_words(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words joined by one space, document by document, and offsets."""
    raw = np.append(words.raw, np.uint8(0))
    step = np.zeros(len(raw) + 1, np.int8)
    np.add.at(step, words.start[keep], 1)
    np.subtract.at(step, words.end[keep], 1)
    taken = np.cumsum(step[:-1], dtype=np.int8) > 0
    which = np.flatnonzero(keep)
    doc = words.doc()[which]
    gap = words.end[which[:-1]][doc[:-1] == doc[1:]]
    raw[gap] = 0x20
    taken[gap] = True
    return raw[taken], np.concatenate([[0], np.cumsum(per_doc(taken[:-1], words.at))])


class SubstringLog:
    """Documents in blocks, batch by batch, with both families of runs and the verdicts so far."""

    def __init__(self, spark: SparkSession, buckets: int, window: int = WINDOW, gram: int = GRAM, fan_out: int = 4, folder: str | None = None):
        self.spark, self.buckets, self.window, self.gram, self.fan_out, self.folder = spark, buckets, window, gram, fan_out, folder
        self.batches, self.blocks = 0, []
        self.prints = FingerprintLog(spark, fan_out, False, self._write)
        self.windows = FingerprintLog(spark, fan_out, True, self._write)

    # --- tables, in the log's folder if it has one
    def _write(self, df: DataFrame, name: str) -> DataFrame:
        if not self.folder:
            return cut(df, name)
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        write(df, path)
        return self._read(path, df.schema)

    def _read(self, path: str, schema) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out._written_at = path
        return out

    def _save(self) -> None:
        """Writes the next manifest; only tables that the newest one lists count."""
        tables = {"blocks": self.blocks, "prints": self.prints.runs, "windows": self.windows.runs, "verdicts": self.windows.replies}
        said = {"batches": self.batches, "buckets": self.buckets, "window": self.window, "gram": self.gram, "fan_out": self.fan_out}
        said["tables"] = {k: [(x._written_at, x.schema.json()) for x in v] for k, v in tables.items()}
        self.spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.batches:06d}")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SubstringLog:
        """The log that a folder holds, by its newest whole manifest."""
        from pyspark.sql.types import StructType

        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = sorted(str(x.getPath().toString()) for x in fs.listStatus(path) if x.getPath().getName().startswith("manifest-"))
        whole = [x for x in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS"))]
        said = json.loads(spark.read.text(whole[-1]).first()[0])
        log = cls(spark, said["buckets"], said["window"], said["gram"], said["fan_out"], folder)
        log.batches = said["batches"]
        tables = {k: [log._read(x, StructType.fromJson(json.loads(schema))) for x, schema in v] for k, v in said["tables"].items()}
        log.blocks, log.prints.runs, log.windows.runs, log.windows.replies = (tables[k] for k in ("blocks", "prints", "windows", "verdicts"))
        return log

    # --- batches
    def add_documents(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """One batch: documents that the log doesn't hold yet (their repeats within it and with it count alike)."""
        blocks = to_blocks(docs, id_col, text_col, batch=self.batches + 1)
        self.add(self._write(blocks, "blocks") if self.folder else blocks)

    def add(self, blocks: DataFrame) -> None:
        window, gram, buckets = self.window, self.gram, self.buckets

        def marks(block: Block) -> pa.RecordBatch | None:
            words = Words(block.raw, block.at)
            _, keys = fingerprints(words, N1.sums(words.hashes()), window, gram)
            keys, _, twice = distinct(keys, np.zeros(len(keys), np.uint64))
            out = messages(block.number, keys, buckets, twice)
            return None if out is None else tightened(out)

        def digests(block: Block, replies: pa.Table) -> pa.Table:
            words = Words(block.raw, block.at)
            sums = N1.sums(words.hashes())
            # each window belongs to one fingerprint, so a block sends it once in all batches
            fits, least = words.fits(window), slide_min(N1.windows(sums, gram), window - gram + 1)
            where = np.flatnonzero(fits & member(mix(least), np.unique(keys_in(replies))))
            a = N1.windows(sums, window)[where]
            b = N2.windows(N2.sums(words.hashes(R2)), window)[where]
            a, b, twice = distinct(a, b)
            out = messages(block.number, a, buckets, twice, b)
            return none if out is None else pa.Table.from_batches([tightened(out)])

        none = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("packed", pa.binary()), ("more0", pa.binary()), ("more1", pa.binary())]).empty_table()
        tidy(self.spark)
        self.batches += 1
        self.blocks.append(blocks)
        hits = self.prints.take(send(blocks, marks, 1, "packed"))
        tidy(self.spark)
        met = self.all_blocks().join(hits.select("block").distinct(), "block", "left_semi")
        # an earlier block's opened windows count as new ones: what it held alone comes in now, with the batch's
        self.windows.take(answer(met, hits, digests, "bucket long, block long, packed binary, more0 binary, more1 binary"))
        del hits, met  # they hold the step's shuffles
        tidy(self.spark)
        if self.folder:
            self._save()
        for family in (self.prints, self.windows):  # no manifest from the newest one on lists them
            for path in family.stale:
                drop_path(self.spark, path)
            family.stale = []

    def all_blocks(self) -> DataFrame:
        out = self.blocks[0]
        for x in self.blocks[1:]:
            out = out.unionByName(x)
        return out

    def results(self, with_text: bool = True, id_col: str = "doc_id") -> DataFrame:
        """One row per document of all batches: id, n_words, n_removed, kept_sha256 and, with_text, the kept words joined by spaces."""
        window = self.window
        tidy(self.spark)

        def clean(block: Block, replies: pa.Table) -> pa.RecordBatch:
            words = Words(block.raw, block.at)
            fits = words.fits(window)
            gone = np.zeros(len(words), bool)
            if replies.num_rows and len(fits):
                both = union(N1.windows(N1.sums(words.hashes()), window), N2.windows(N2.sums(words.hashes(R2)), window))
                flags = fits & member(both, np.unique(keys_in(replies)))
                gone = cover(flags, window, len(words))
            kept, at = kept_words(words, ~gone)
            sha = [hashlib.sha256(kept[at[i] : at[i + 1]]).hexdigest() for i in range(len(block.ids))]
            columns = [pa.array(block.ids), pa.array(np.diff(words.first)), pa.array(per_doc(gone, words.first)), pa.array(sha, pa.string())]
            if with_text:
                columns.append(pa.array([kept[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(block.ids))], pa.string()))
            return pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

        return answer(self.all_blocks(), told(self.windows.replies), clean, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 3, fan_out: int = 4, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, with_text, the kept words joined by spaces."""
    blocks = to_blocks(docs, id_col, text_col)
    log = SubstringLog(docs.sparkSession, bucket_count(blocks), window, gram, fan_out)
    for i in range(batches):
        log.add(blocks.where(F.pmod(F.xxhash64("block"), F.lit(batches)) == i))
    words = F.expr(f"regexp_extract_all(coalesce(cast(`{text_col}` as string), ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")
    whole = F.array_join(words, " ")
    nameless = [F.size(words).cast("long"), F.lit(0).cast("long"), F.sha2(whole.cast("binary"), 256), *[whole] * with_text]
    return log.results(with_text, id_col).union(docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long"), *nameless))
