"""Recall of the multiprobe search against brute force on larger tables, and its cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.llm import neighbours


def brute(v, q, k=5):
    u = v.astype(np.float64)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u[q]
    s[q] = -9
    return set(np.argsort(-s, kind="stable")[:k].tolist())


@pytest.mark.parametrize("n", [300, 12_000])
def test_recall(spark, n):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((n // 40, 24))
    v = (centres[rng.integers(0, len(centres), n)] + 0.5 * rng.standard_normal((n, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(n)], "vec_id long, embedding array<float>")
    found = neighbours.search(df).toPandas()
    hits = sum(len(brute(v, q) & set(g.vec_id)) for q, g in found.groupby("query_id"))
    assert hits >= 0.9 * 5 * len(range(0, n, 50)) and (found.groupby("query_id").size() == 5).all()


def test_a_small_table_is_hashed_too(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(500)], "id long, v array<double>")
    hashing, visits = neighbours.fit(df, df.where("id % 50 = 0"), 5, 8, 500)
    assert hashing.projections >= 1 and 1 <= visits <= neighbours.MOST


def test_mixed_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [9.0, 9.0]), (2, [0.0, 1.0]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 0.2, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cells", F.lit(1))
    runs = [sorted(tuple(r) for r in neighbours.search(df.repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and [r[:3] for r in runs[0]] == [(0, 1, 1), (0, 2, 2), (50, 1, 51)]
    assert np.isclose(runs[0][0][3], 1 / np.hypot(1, 0.1))
