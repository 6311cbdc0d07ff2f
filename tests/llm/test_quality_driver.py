"""The classifier's sample and its decomposition stay in a task; the driver gets the finished space."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm.common import as_bytes, ship
from tessera.llm.quality_knn import FEATURES, Space, features, fit


def tables(spark):
    rows = [(i, f"Word{i % 7} and THE {i % 3} others, {'x' * (i % 5)}; line {i}") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")


def test_the_driver_holds_neither_features_nor_decomposition(spark):
    ship(spark)
    docs, labels = tables(spark)
    tracemalloc.start()
    try:
        space = fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert space.axes.shape == (FEATURES, 48) and len(space.labels) == 60
    # one matrix of FEATURES x FEATURES doubles is 32 MB
    assert peak < 16 << 20


def test_the_space_is_learnt_from_the_sample_in_order(spark):
    ship(spark)
    docs, labels = tables(spark)
    got = fit(docs, labels)
    order = [r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h", "doc_id").collect()]
    text, good = dict(docs.collect()), dict(labels.collect())
    x = features(*as_bytes(pa.array([text[i] for i in order]))).astype(np.float16).astype(np.float32)
    want = Space(x, np.array([good[i] >= 1 for i in order]), 48, 15, 4.0)
    assert np.array_equal(got.labels, want.labels)
    # axes of equal eigenvalues may turn with the number of threads, and the column of texts' borders depends on how rows are cut
    assert np.array_equal(*(np.delete(v.weight, FEATURES - 3) for v in (got, want)))


def test_no_usable_labels(spark):
    ship(spark)
    docs, labels = tables(spark)
    for d, y in ((docs, labels.where("false")), (docs.where("false"), labels)):
        space = fit(d, y)
        assert space.prior == 0.5 and space.score(np.zeros((1, FEATURES), np.float32)).tolist() == [0.5]
