"""Benchmark decontamination by winnowing (operator 7).

Every `window` consecutive words of a test item, or the whole of a shorter item, must not occur in a
training document.  Both sides keep the least `gram`-gram hash of each window (winnowing), which
guarantees a shared fingerprint for every shared window; training and test fingerprints are joined, and
each hit is extended to the windows around it, which are compared by two independent hashes over all
their words.  Items of fewer words are compared as a whole at each place of a document.

Size: the test side goes to the workers in parts of at most `part_bytes` of item text, each a broadcast
of bounded size; with several parts, workers hold `hold_bytes` of documents and take the parts in
turn, so neither side needs to fit in memory and documents are read once.  No shuffle, so no skew.

Defined results: null and empty texts have no words and are clean; null or empty items never match;
repeated items (one id or several) count once per id; repeated documents are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ITEM_WORD, LOWER, N1, N2, Words, as_bytes, col, member, mix, per_doc, slices, winnow

WINDOW, GRAM = 10, 5


class TestPart:
    """Fingerprints and windows of some test items."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str | None], window: int, gram: int):
        raw, at = as_bytes(pa.array(texts, pa.string()))
        words = Words(LOWER[raw], at, ITEM_WORD)
        hashes, doc, count = words.hashes(), words.doc(), np.diff(words.first)
        a, b = N1.sums(hashes), N2.sums(hashes)
        fits = words.fits(gram)
        grams = N1.windows(a, gram)
        marks = winnow(grams, window - gram + 1)
        self.ids, self.window, self.gram = ids, window, gram
        self.marks = np.unique(grams[marks[fits[marks]]]) if len(marks) else grams[:0]
        #: by window length: first hashes in order, second hashes, item of each
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {window, *(int(n) for n in np.unique(count) if 0 < n < window)}:
            fits = words.fits(size)
            first = np.flatnonzero(fits & (count[doc[: len(fits)]] >= window if size == window else count[doc[: len(fits)]] == size))
            keys, check, owner = N1.windows(a, size)[first], N2.windows(b, size)[first], doc[first]
            order = np.argsort(keys, kind="stable")
            if len(order):
                self.windows[size] = keys[order], check[order], owner[order]

    def match(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words lie in a window of an item; pairs (document, item)."""
        a, b, doc = N1.sums(hashes), N2.sums(hashes), words.doc()
        step = np.zeros(len(words) + 1, np.int32)
        docs, items = [], []
        for size, (keys, check, owner) in self.windows.items():
            fits = words.fits(size)
            if not len(fits):
                continue
            if size == self.window:  # fingerprints join first; hits extend to the windows that hold them
                grams = N1.windows(a, self.gram)
                near = np.zeros(len(words) + 1, np.int32)
                marks = winnow(grams, size - self.gram + 1)
                marks = marks[member(grams[marks], self.marks)]
                np.add.at(near, np.maximum(marks - (size - self.gram), 0), 1)
                np.subtract.at(near, marks + 1, 1)
                where = np.flatnonzero((np.cumsum(near)[: len(fits)] > 0) & fits)
            else:
                where = np.flatnonzero(fits)
            found = (a[where + size] - a[where]) * N1.inverses[where]
            found = mix(found)
            hit = member(found, keys)
            where, found = where[hit], found[hit]
            if not len(where):
                continue
            second = N2.windows(b, size)[where]
            lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
            source = np.repeat(np.arange(len(where)), hi - lo)
            target = np.arange(len(source)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[source]
            same = check[target] == second[source]
            source, target = source[same], target[same]
            places = where[np.unique(source)]
            np.add.at(step, places, 1)
            np.subtract.at(step, places + size, 1)
            pairs = np.unique(np.stack([doc[where[source]], owner[target]]), axis=1)
            docs.append(pairs[0]), items.append(pairs[1])
        nothing = np.zeros(0, np.int64)
        return np.cumsum(step[:-1]) > 0, np.concatenate([nothing, *docs]), np.concatenate([nothing, *items])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, part_bytes: int = 1 << 22, hold_bytes: int = 1 << 25, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep_clean: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, item_ids (sorted as strings), contaminated.

    With keep_clean: the rows of docs that aren't contaminated, all columns.
    """
    sc = docs.sparkSession.sparkContext
    parts, ids, texts, size = [], [], [], 0

    def close() -> None:
        nonlocal size
        if ids:
            parts.append(sc.broadcast(TestPart(list(ids), list(texts), window, gram)))
        ids.clear(), texts.clear()
        size = 0

    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").toLocalIterator():
        if size + len(row.t) * 4 > part_bytes:
            close()
        ids.append(row.i), texts.append(row.t)
        size += len(row.t.encode())
    close()
    many, text = len(parts) > 1, text_col if keep_clean else "_text"

    def judge(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = []
        for part in held:
            raw, at = as_bytes(col(part, text))
            words = Words(LOWER[raw], at, ITEM_WORD)
            work.append((part, words, np.zeros(len(words), bool), [set() for _ in range(part.num_rows)]))
        for shared in parts:
            test = shared.value
            for _, words, hit, names in work:
                inside, doc, item = test.match(words, words.hashes())
                hit |= inside
                for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                    names[d].add(test.ids[i])
            if many:
                del shared._value  # the next part takes its place in memory
        for part, words, hit, names in work:
            n = per_doc(hit, words.first)
            if keep_clean:
                yield part.filter(pa.array(n == 0))
                continue
            yield pa.RecordBatch.from_arrays([col(part, "_id"), pa.array(np.diff(words.first)), pa.array(n), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(n > 0)], [id_col, "n_words", "n_hit", "item_ids", "contaminated"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, text):
            held.append(part)
            size += part.nbytes
            if not many or size >= hold_bytes:
                yield from judge(held)
                held, size = [], 0
        if held:
            yield from judge(held)

    if keep_clean:
        return docs.mapInArrow(run, docs.schema)
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = picked.schema["_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_hit long, item_ids array<string>, contaminated boolean")


def digest(found: DataFrame) -> DataFrame:
    """The counts and the hash of the item ids."""
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
