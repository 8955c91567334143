"""Lloyd's rounds against a plain version in unbounded integers."""

import hashlib
import math
import random

import duckdb

from linkspark.llm import centroids

ROWS = "vec_id long, embedding array<double>, cluster string, uid long, distance int"


def plain(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(64 * x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[0], r[1]))
    means = [list(v) for _, v in order[:k]]
    near = lambda v: min(((min(sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), 2**63 - 1)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for c, vs in groups.items():
            means[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in kept), means


def check(spark, rows, k=5, dim=6, width=4):
    df = spark.createDataFrame([(i, v, "c", 0, 0) for i, v in rows], ROWS)
    found, means = centroids.cluster(df, k=k, dim=dim, width=width)
    assert (sorted(map(tuple, found.collect())), means) == plain(rows, k, 3, dim)


def test_rounds_equal_plain_ones(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(i % 4, 0.7) for _ in range(6)]) for i in range(300)]
    rows += [(None, [0.0] * 6), (7000, None), (7001, [1.0] * 5), (7002, [1.0] * 5 + [None]), (7003, [1.0] * 5 + [float("nan")]), (7004, [float("inf")] * 6)]
    rows += [(5, [9.0] * 6), (5, [9.0] * 6), (8000, [-0.001] * 6), (8001, [0.0] * 6)]
    check(spark, rows)
    check(spark, rows[:3])
    check(spark, [(i, [2.0] * 6) for i in range(40)])


def test_large_components(spark):
    rnd = random.Random(4)
    check(spark, [(i, [rnd.uniform(-1, 1) * 2.0 ** rnd.choice([0, 20, 24, 60]) for _ in range(6)]) for i in range(60)])
    check(spark, [(i, [1e305 * (i % 3), 1.0, 2.0, 3.0, 4.0, float(i)]) for i in range(30)])


def test_empty(spark):
    df = spark.createDataFrame([], ROWS)
    assert centroids.cluster(df)[0].count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = centroids.op13_centroid_clustering(spark, sf)
    asked = con.execute(centroids.oracle())
    names = [c[0] for c in asked.description]
    assert names == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(asked.fetchall())
