"""Centroid clustering by Lloyd's rounds, sharded over dimensions.

A vector is cut into blocks of WIDTH columns, the shards. The blocks are written once,
dealt by shard and vector. In each round the tasks compute a block's exact partial
distances to the same columns of every centroid; partial distances of a vector are
added by key, and the smallest sum, ties to the smaller number, is its centroid. Then
every shard adds up its own columns by cluster, first within a task, and divides: it
updates its own slice of the centroids. Between rounds only partial distances,
assignments and sums move, never vectors. The centroids, ``k`` times the length of a
vector, are all that the driver and every task hold.

Components are integers, ``floor(SCALE * x)``. They are multiplied in 64 bits where
their bounds allow it and as unbounded integers elsewhere; sums of columns are
unbounded. A distance or a sum of distances of 2**63 - 1 and more is held as that.

Defined cases: vectors that are null, of another length, or hold a null or a component
that is not finite (once scaled) take no part, nor do rows without an id; repeated ids
are vectors of their own, in the order of their vectors where they start a centroid;
with fewer vectors than ``k`` there are as many centroids; an empty cluster keeps its
centroid; an empty table gives an empty result; other columns of the input are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, ship, table

K, ROUNDS, DIM, SCALE, WIDTH, SEED = 16, 3, 64, 64, 32, 1
MOST = 2**63 - 1
#: Components up to this size, and WIDTH squares of their differences, fit in 64 bits.
SMALL = 2**27


def kept(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """``id, v`` of the vectors that take part."""
    kind = "array<float>" if dict(rows.dtypes)[vector] == "array<float>" else "array<double>"
    df = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
    wide = lambda x: x.cast("double") * F.lit(float(SCALE))
    return df.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(wide(x)) == float("inf"))))


def whole(blocks: np.ndarray) -> np.ndarray:
    """Components as integers: of 64 bits, or unbounded ones where those are too few."""
    scaled = np.floor(blocks.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], object).reshape(scaled.shape)


def distances(blocks: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances, rows x centroids, of MOST at most."""
    small = blocks.dtype == np.int64 and all(abs(x) < SMALL for c in centroids for x in c)
    if small:
        return np.stack([((blocks - np.array(c, np.int64)) ** 2).sum(axis=1) for c in centroids], 1)
    exact = np.stack([((blocks.astype(object) - np.array(c, object)) ** 2).sum(axis=1) for c in centroids], 1)
    return np.minimum(exact, MOST).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_shard(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    shards = batch.column(at).to_numpy()
    for s in np.unique(shards):
        yield int(s), batch.filter(pa.array(shards == s))


def assigned(blocks: DataFrame, centroids: list[list[int]], width: int) -> DataFrame:
    """``uid, cluster, distance``: partial distances by block, added by vector."""
    sent = blocks.sparkSession.sparkContext.broadcast(centroids)
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, part in _by_shard(batch, 1):
                found = distances(whole(_matrix(part.column(2))), [c[s * width : (s + 1) * width] for c in sent.value])
                lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * k, pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["uid", "d"])

    partial = map_batches(blocks.select("uid", "shard", "block"), run, "uid long, d array<long>")
    sums = partial.groupBy("uid").agg(*[F.sum(F.col("d")[i].cast("decimal(38,0)")).alias(f"d{i}") for i in range(k)])
    every = F.array(*[F.least(F.col(f"d{i}"), F.lit(MOST).cast("decimal(38,0)")).cast("long") for i in range(k)])
    least = sums.select("uid", every.alias("d")).select("uid", "d", F.array_min("d").alias("distance"))
    return least.select("uid", (F.array_position("d", F.col("distance")) - 1).cast("int").alias("cluster"), "distance")


def updated(blocks: DataFrame, found: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The centroids after a round: each shard's sums by cluster, floored means."""
    shards = range((len(centroids[0]) + width - 1) // width)
    to = found.select("uid", "cluster", F.explode(F.array(*map(F.lit, shards))).alias("shard"))
    members = blocks.join(to, ["shard", "uid"]).select("shard", "cluster", "block")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for batch in batches:
            clusters = batch.column(1).to_numpy()
            for s, c in sorted(set(zip(batch.column(0).to_pylist(), clusters.tolist(), strict=True))):
                own = pa.array((batch.column(0).to_numpy() == s) & (clusters == c))
                block = whole(_matrix(batch.column(2).filter(own)))
                before = total.get((s, c), (0, [0] * block.shape[1]))
                total[s, c] = before[0] + len(block), [x + int(y) for x, y in zip(before[1], block.sum(axis=0), strict=True)]
        yield from _rows(total)

    def added(group: pa.Table) -> pa.Table:
        lists = [[int(x) for x in row] for row in group.column("sums").to_pylist()]
        total = reduce(lambda a, b: [x + y for x, y in zip(a, b, strict=True)], lists)
        s, c = group.column("shard")[0].as_py(), group.column("cluster")[0].as_py()
        return pa.Table.from_batches(_rows({(s, c): (sum(group.column("n").to_pylist()), total)}))

    schema = "shard int, cluster int, n long, sums array<string>"
    slices = map_batches(members, sums, schema).groupBy("shard", "cluster").applyInArrow(added, schema).collect()  # k rows a shard
    out = [list(c) for c in centroids]
    for r in slices:
        out[r["cluster"]][r["shard"] * width : (r["shard"] + 1) * width] = [int(x) // r["n"] for x in r["sums"]]
    return out


def _rows(total: dict[tuple[int, int], tuple[int, list[int]]]) -> list[pa.RecordBatch]:
    names, kinds = ["shard", "cluster", "n", "sums"], [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
    rows = [(s, c, n, list(map(str, x))) for (s, c), (n, x) in total.items()]
    return [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)]


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, width: int = WIDTH) -> tuple[DataFrame, list[list[int]]]:
    """``id, cluster, distance`` of every vector, and the centroids."""
    spark = rows.sparkSession
    ship(spark)
    # numbered once, and written: a repeated id does not name a vector
    vectors = table(kept(rows, key, vector, dim).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    by_hash = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("id").cast("string")), 256)
    first = vectors.select(by_hash.alias("h"), "id", "v").orderBy("h", "id", "v").limit(k).collect()
    centroids = [[int(x) for x in whole(np.array([r["v"]]))[0]] for r in first]
    if not centroids:
        return spark.createDataFrame([], "id long, cluster int, distance long"), []
    cuts = F.array(*[F.slice("v", at + 1, width) for at in range(0, dim, width)])
    blocks = cut(vectors.select("uid", F.posexplode(cuts).alias("shard", "block")).repartition("shard", "uid"))
    for _ in range(rounds):
        centroids = updated(blocks, cut(assigned(blocks, centroids, width)), centroids, width)
    found = vectors.select("uid", "id").join(cut(assigned(blocks, centroids, width)), "uid")
    return found.select("id", "cluster", "distance"), centroids


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """The cluster of every vector, with the inertias and its centroid's digest."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # a row for each centroid
    total = min(int(sum(sums.values())), MOST)
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    rows = [(c, min(int(n), MOST), total, digest(c)) for c, n in sums.items()]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.withColumnRenamed("id", "vec_id").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The same rounds in DuckDB, over one row for each component."""
    nearest = """a{n} AS MATERIALIZED (SELECT uid, c, d FROM (SELECT uid, c, d, row_number() OVER (PARTITION BY uid ORDER BY d, c) AS nth
        FROM (SELECT e.uid, m.c, CAST(sum((e.x - m.x) * (e.x - m.x)) AS BIGINT) AS d FROM e JOIN m{n} AS m ON m.i = e.i GROUP BY 1, 2)) WHERE nth = 1)"""
    moved = """s{n} AS MATERIALIZED (SELECT a.c, e.i, CAST(sum(e.x) AS BIGINT) AS s, count(*) AS n FROM a{b} AS a JOIN e ON e.uid = a.uid GROUP BY 1, 2),
        m{n} AS MATERIALIZED (SELECT m.c, m.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, m.x) AS x FROM m{b} AS m LEFT JOIN s{n} AS s ON s.c = m.c AND s.i = m.i)"""
    steps = [nearest.format(n=0)]
    for n in range(1, ROUNDS + 1):
        steps += [moved.format(n=n, b=n - 1), nearest.format(n=n)]
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, embedding FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE) * {SCALE}))) = 0),
    e AS MATERIALIZED (SELECT uid, t.i, CAST(floor(CAST(embedding[t.i] AS DOUBLE) * {SCALE}) AS BIGINT) AS x FROM v, range(1, {DIM + 1}) AS t(i)),
    f AS (SELECT uid, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), vec_id, embedding) - 1 AS c FROM v),
    m0 AS MATERIALIZED (SELECT c, i, x FROM f JOIN e USING (uid) WHERE c < {K}),
    {", ".join(steps)},
    h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m{ROUNDS} GROUP BY c)
    SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a{ROUNDS} AS a JOIN v USING (uid) JOIN h USING (c)"""
