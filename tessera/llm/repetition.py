"""Quality rules by repetition coverage (operator 3).

For several n-gram lengths, rolling hashes over words find the n-grams that a document holds
twice or more; the share of the document's word characters inside them, each counted once, is
its repetition coverage at that length.  Lines get the same measure.  One pass, no shuffle.

Defined results: a null or empty text has no words, so it fails the base rule (fewer than 20
words); repeated rows are judged alike; other columns of the input don't matter, an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import N1, R1, Words, as_bytes, col, cover, in_doc, per_doc, repeated, slices

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Coverage above which a document goes, by n-gram length; and for lines and symbols.

    Above the most that any document labelled good has at sf0.1 (0.28, 0.28, 0.18; lines 0.28), below what the base
    rule leaves through; they fall with the length, as longer n-grams' words are among those of shorter ones.
    """

    coverage: tuple[tuple[int, float], ...] = ((5, 0.40), (8, 0.30), (10, 0.20))
    line_coverage: float = 0.30
    symbols_per_word: float = 0.10
    least_words: int = 20
    window: int = 8
    window_percent: int = 30


def measure(raw: np.ndarray, at: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """All measures of a run of documents."""
    n = len(at) - 1
    words = Words(raw, at)
    doc = words.doc()
    points = (raw & 0xC0) != 0x80
    upto = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(points, out=upto[1:])
    chars = upto[words.end] - upto[words.start]
    out = {
        "n_words": np.diff(words.first),
        "word_chars": per_doc(chars, words.first),
        "n_symbols": per_doc(SYMBOL[raw], at),
    }
    sums = N1.sums(words.hashes())
    total = np.maximum(out["word_chars"], 1)
    for size in sorted({rules.window, *(k for k, _ in rules.coverage)}):
        flags = np.zeros(0, bool)
        fits = words.fits(size)
        if len(fits):
            flags = fits.copy()
            flags[fits] = repeated(in_doc(N1.windows(sums, size)[fits], doc[: len(fits)][fits]))
        inside = cover(flags, size, len(words))
        if size == rules.window:
            out["n_repeat_words"] = per_doc(inside, words.first)
        out[f"cover_{size}"] = per_doc(chars * inside, words.first) / total
    # lines: stretches between \n and the borders of documents, that hold a word
    cuts = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([at[:-1], cuts + 1]))
    start = start[start < len(raw)]
    end = np.append(start[1:], len(raw))
    end = end - ((end > start) & (raw[np.maximum(end, 1) - 1] == 10)) if len(raw) else end
    first_word = np.searchsorted(words.start, start)
    last_word = np.searchsorted(words.start, end)
    held = last_word > first_word
    start, end, first_word, last_word = start[held], end[held], first_word[held], last_word[held]
    owner = np.searchsorted(at, start, "right") - 1
    keys = in_doc(R1.spans(R1.sums(raw), start, end), owner)
    distinct = np.zeros(n, np.int64)
    if len(keys):
        _, firsts = np.unique(keys, return_index=True)
        distinct = np.bincount(owner[firsts], minlength=n)
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - distinct
    word_upto = np.zeros(len(words) + 1, np.int64)
    np.cumsum(chars, out=word_upto[1:])
    twice = repeated(keys)
    out["cover_lines"] = np.bincount(owner[twice], (word_upto[last_word] - word_upto[first_word])[twice], minlength=n) / total
    return out


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def repetition_quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, the base counts, coverage by length (cover_5, ...), the verdict.

    kept is false where the base rule fails, a coverage is above its limit, or there are more than
    `symbols_per_word` symbols of `#*$%&|<>` for each word.
    """
    sizes = sorted({rules.window, *(k for k, _ in rules.coverage)})
    limits = dict(rules.coverage)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            m = measure(*as_bytes(col(part, "_text")), rules)
            n = m["n_words"]
            failed = (n < rules.least_words) | (100 * m["n_repeat_words"] > rules.window_percent * n)
            bad = (m["cover_lines"] > rules.line_coverage) | (m["n_symbols"] > rules.symbols_per_word * n)
            for size, most in limits.items():
                bad |= m[f"cover_{size}"] > most
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            columns = [col(part, "_id"), *(pa.array(m[x].astype(np.int64)) for x in names), pa.array(failed), pa.array(~(failed | bad))]
            columns += [pa.array(m[f"cover_{k}"].astype(float)) for k in (*sizes, "lines")]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *names, "base_failed", "kept", *(f"cover_{k}" for k in (*sizes, "lines"))])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = picked.schema["_id"].dataType.simpleString()
    return picked.mapInArrow(work, f"`{id_col}` {kind}, {SCHEMA}, " + ", ".join(f"cover_{k} double" for k in (*sizes, "lines")))
