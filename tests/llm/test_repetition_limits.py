"""Each limit of the repetition rules, with a document that only it rejects."""

import pyarrow as pa
import pytest

from tessera.llm.common import as_bytes
from tessera.llm.repetition import Rules, measure, repetition_quality

NEW = iter(f"u{i:04d}" for i in range(10_000))


def unique(n):
    return " ".join(next(NEW) for _ in range(n))


def phrase(tag, n, size):
    return " ".join(f"{tag}{i}".ljust(size, "z") for i in range(n))


DOCS = {
    "lines": "\n".join(f"{phrase(t, 4, 5)}\n{unique(6)}\n{phrase(t, 4, 5)}\n{unique(6)}" for t in "abcd"),
    "cover_5": " ".join(f"{phrase(t, 6, 5)} {unique(4)} {phrase(t, 6, 5)} {unique(4)}" for t in "efgh"),
    "cover_8": " ".join(f"{phrase(t, 8, 8)} {unique(22)} {phrase(t, 8, 8)} {unique(22)}" for t in "ijkl"),
    "cover_10": " ".join(f"{phrase(t, 12, 5)} {unique(38)} {phrase(t, 12, 5)} {unique(38)}" for t in "mnop"),
    "none": unique(300),
}


@pytest.mark.parametrize("name", DOCS)
def test_each_limit_rejects_alone(spark, name):
    rules = Rules()
    m = measure(*as_bytes(pa.array([DOCS[name]])), rules)
    over = {f"cover_{k}" for k, most in rules.coverage if m[f"cover_{k}"][0] > most} | ({"lines"} if m["cover_lines"][0] > rules.line_coverage else set())
    assert over == {name} - {"none"}
    row = repetition_quality(spark.createDataFrame([(1, DOCS[name])], "doc_id long, text string")).first()
    assert not row["base_failed"] and row["kept"] == (name == "none")
