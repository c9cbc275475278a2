"""Vectors whose squares underflow or overflow take part like others."""

import numpy as np
from pyspark.sql import functions as F

from loanloom.llm import neighbours


def test_very_small_and_large_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    scales = np.array([1.0, 1e-200, 1e200, 1e-310, 1e307])[np.arange(30) % 5]
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(base, scales))] + [(99, [0.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(table, F.col("vec_id") % 10 == 0, k=29).collect()
    assert {r.vec_id for r in found} | {r.query_id for r in found} == set(range(30)) and len(found) == 3 * 29
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    for r in found:
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-6


def test_scaling_changes_no_digit():
    rng = np.random.default_rng(3)
    import pyarrow as pa
    vectors = rng.normal(size=(50, 16)) * np.exp(rng.normal(size=(50, 1)) * 5)
    _, scaled = neighbours._matrix(pa.table({"vec_id": np.arange(50), "embedding": vectors.tolist()}))
    for v in (vectors, scaled):
        norms = np.sqrt((v * v).sum(axis=1))
        cosines = [neighbours.cosines(v, norms, q, n) for q, n in zip(v, norms)]
        first = cosines if v is vectors else first
    assert np.array_equal(first, cosines)
