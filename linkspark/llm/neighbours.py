"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a unit vector to the cell of its Gaussian (2-stable) projections,
each cut into intervals. A query visits, in every table, the cells most likely to
hold a neighbour, in that order: a projection of a neighbour with cosine r to the
query is normal around r times the query's own, which gives each interval, and so
each perturbed cell, its chance. The candidates of all visited cells are ranked by
the exact cosine.

A bounded sample (SAMPLE queries) is searched exactly, over all rows, to fit r and
the number of visits that reaches RECALL on it; every row is in the index. Where no
number of visits up to MOST does, there are twice the tables, and then projections
less by one, down to none, where one cell holds all rows and the search is exact:
tables of every size are searched in this way. A cell with many rows or
many visits is split over tasks; each pair of parts meets, so nothing is capped. Of
equal vectors only the k + 1 smallest ids can be an answer, and only those are indexed.

Defined cases: vectors that are null, zero, or hold a null or a component that is
not finite take no part, as queries or candidates; vectors of other lengths are not
compared with each other; equal scores are ordered by id; a query with fewer
candidates than k returns all its candidates; of repeated ids the smallest vector
counts, as a candidate and as a query; null ids take no part; an empty table gives an empty
result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, ship

K, EVERY = 5, 50
TABLES, WIDTH, SEED = 6, 2.0, 5
#: Rows that a cell should hold.
PER_CELL = 200
SAMPLE, RECALL, MOST = 96, 0.96, 600
#: Rows and visits of a cell that meet in one task.
PART = 4096


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function, to a ten-millionth (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - tail * np.exp(-x * x))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that no square leaves the range."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same whatever rows stand beside."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


@dataclass(frozen=True)
class Hashing:
    dim: int
    projections: int  # for each table
    tables: int = TABLES
    r: float = 0.5

    def drawn(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([SEED, self.dim])
        shape = (self.tables, self.projections)
        return rng.standard_normal((*shape, self.dim)), rng.random(shape) * WIDTH

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Projections, shifted and in widths: tables x rows x projections."""
        a, b = self.drawn()
        return (np.einsum("nd,tpd->tnp", unit(vectors), a, optimize=True) + b[:, None, :]) / WIDTH

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Cell keys: tables x rows."""
        return _keys(np.floor(self.places(vectors)).astype(np.int64))

    def visits(self, vectors: np.ndarray, most: int) -> np.ndarray:
        """Keys of the ``most`` likeliest cells, likeliest first: tables x rows x cells."""
        _, b = self.drawn()
        spread = np.sqrt(1 - self.r**2) * np.sqrt(2)
        out = []
        for places, shift in zip(self.places(vectors), b, strict=True):
            n = len(places)
            best, logs = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1))
            for j in range(self.projections):
                options = np.floor(places[:, j]).astype(np.int64)[:, None] + np.arange(-3, 4)
                mean = self.r * (places[:, j] * WIDTH - shift[j])[:, None]
                edge = lambda c: 0.5 * (1 + _erf((c * WIDTH - shift[j] - mean) / spread))  # noqa: E731, B023
                chance = np.log(np.maximum(edge(options + 1) - edge(options), 1e-9))
                # a likely cell is likely in its first projections too: the best prefixes suffice
                logs = (logs[:, :, None] + chance[:, None, :]).reshape(n, -1)
                width = best.shape[1]
                order = np.argsort(-logs, axis=1, kind="stable")[:, :most]
                before = np.take_along_axis(best, (order // 7)[:, :, None], 1) if j else np.zeros((n, order.shape[1], 0), np.int64)
                last = np.take_along_axis(np.tile(options, (1, width)), order, 1)
                best, logs = np.concatenate([before, last[:, :, None]], axis=2), np.take_along_axis(logs, order, 1)
            out.append(_keys(best))
        return np.stack(out)


def _keys(cells: np.ndarray) -> np.ndarray:
    out = np.full(cells.shape[:-1], 1469598103934665603, np.uint64)
    for j in range(cells.shape[-1]):
        out = (out ^ cells[..., j].astype(np.uint64)) * np.uint64(1099511628211)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` of the vectors that take part, single or double as they came."""
    kind = "array<float>" if dict(rows.dtypes)[vector] == "array<float>" else "array<double>"
    df = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(~bad & F.exists("v", lambda x: x != 0.0)).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def exact(queries: list[tuple[int, list[float]]], rows: DataFrame, k: int, dim: int) -> list[tuple[int, int, float]]:
    """(query, id, score) of a bounded list of queries, against all rows."""
    ids = np.array([q for q, _ in queries])
    asked = np.array([v for _, v in queries], dtype=np.float64)
    sent = rows.sparkSession.sparkContext.broadcast((ids, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        for batch in batches:
            own = np.asarray(batch.column(0))
            scores = unit(asked) @ unit(_matrix(batch.column(1), dim)).T
            scores[ids[:, None] == own[None]] = -np.inf
            n = min(k, len(own))
            top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            flat = np.take_along_axis(scores, top, 1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(own[top].ravel()), pa.array(flat)], names=["q", "id", "score"])

    found = map_batches(rows.select("id", "v"), run, "q long, id long, score double").where(F.col("score") > float("-inf"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)  # k for each of SAMPLE queries
    return [(r["q"], r["id"], r["score"]) for r in best.collect()]


def fit(index: DataFrame, queries: DataFrame, k: int, dim: int, n: int) -> tuple[Hashing, int]:
    """The hashing for ``n`` rows and the number of visits in each table."""
    first = max(1, round(np.log2(max(n, 2) / PER_CELL) / 1.1))
    sample = [(r["id"], r["v"]) for r in queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    true = exact(sample, index, k, dim) if sample else []
    if not true:
        return Hashing(dim, first), 1
    wanted = {i for _, i, _ in true}
    known = {r["id"]: r["v"] for r in index.join(F.broadcast(index.sparkSession.createDataFrame([(i,) for i in wanted], "id long")), "id").collect()}
    r = float(np.clip(np.median([s for _, _, s in true]), 0.05, 0.98))
    place = {q: i for i, (q, _) in enumerate(sample)}
    asked = np.array([v for _, v in sample], dtype=np.float64)
    near = np.array([known[i] for _, i, _ in true], dtype=np.float64)
    of = np.array([place[q] for q, _, _ in true])
    for projections in range(first, 0, -1):
        for tables in (TABLES, 2 * TABLES):
            hashing = Hashing(dim, projections, tables, r)
            visits, cells = hashing.visits(asked, MOST), hashing.cells(near)
            ranks = np.full(len(true), MOST)
            for t in range(tables):
                hit = visits[t][of] == cells[t][:, None]
                ranks = np.minimum(ranks, np.where(hit.any(axis=1), hit.argmax(axis=1), MOST))
            need = int(np.quantile(ranks, RECALL, method="higher")) + 1
            if need <= visits.shape[2]:
                return hashing, need
    return Hashing(dim, 0, 1, r), 1  # one cell of all rows: every query meets each of them


def search(rows: DataFrame, queries: DataFrame | None = None, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``; ``queries`` has the rows to ask for, by
    default those whose id is divisible by EVERY."""
    spark = rows.sparkSession
    ship(spark)
    every = valid(rows, key, vector)
    asked = valid(queries, key, vector) if queries is not None else every.where(F.col("id") % EVERY == 0)
    # of equal vectors those that can be answers; ranked in part before the shuffle
    same = Window.partitionBy("v").orderBy("id")
    index = cut(every.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).select("id", "v"))
    out = None
    for dim, n in sorted((r["dim"], r["n"]) for r in index.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()):
        part = _search(index.where(F.size("v") == dim), asked.where(F.size("v") == dim), k, dim, n)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "q long, id long, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = out.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def _search(index: DataFrame, asked: DataFrame, k: int, dim: int, n: int) -> DataFrame:
    hashing, most = fit(index, asked, k, dim, n)
    tables = hashing.tables
    kind = dict(index.dtypes)["v"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = hashing.cells(_matrix(batch.column(1), dim))
            flat = pa.array(cells.T.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * tables, flat)], names=["id", "v", "cells"])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                visits = hashing.visits(_matrix(part.column(1), dim), most)
                m = visits.shape[2]
                for t in range(tables):
                    cells = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * m, pa.array(visits[t].ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(part.num_rows, t, np.int32)), cells], names=["q", "t", "cells"])

    cells = map_batches(index, placed, f"id long, v {kind}, cells array<long>").select("id", "v", F.posexplode("cells").alias("t", "cell"))
    spread = max(8, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ids alone: once for each query and table
    visits = cut(map_batches(asked.select("id", "v").repartition(spread, "id"), visiting, "q long, t int, cells array<long>"))
    visits = visits.select("q", "t", F.explode("cells").alias("cell"))
    sizes = cells.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n")).join(visits.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("m")), ["t", "cell"])
    sizes = cut(sizes.select("t", "cell", F.ceil(F.col("n") / PART).cast("int").alias("a"), F.ceil(F.col("m") / PART).cast("int").alias("b")))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = cells.join(sizes, ["t", "cell"]).select("t", "cell", F.pmod(F.xxhash64("id"), F.col("a")).cast("int").alias("i"), upto("b").alias("j"), "id", "v")
    # a query's vector joins the visits to cells that hold rows
    met = visits.join(sizes, ["t", "cell"]).join(asked.select(F.col("id").alias("q"), F.col("v").alias("w")), "q")
    right = met.select("t", "cell", upto("a").alias("i"), F.pmod(F.xxhash64("q"), F.col("b")).cast("int").alias("j"), "q", "w")

    def ranked(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "id": [], "score": []}).astype({"q": "int64", "id": "int64"})
        ids, qs = a["id"].to_numpy(), b["q"].to_numpy()
        x, y = np.stack(a["v"].to_numpy()).astype(np.float64), np.stack(b["w"].to_numpy()).astype(np.float64)
        ux = unit(x)
        found = []
        for at in range(0, len(qs), 256):
            q = qs[at : at + 256]
            scores = unit(y[at : at + 256]) @ ux.T
            scores[q[:, None] == ids[None]] = -np.inf
            m = min(k, len(ids))
            edge = -np.partition(-scores, m - 1, axis=1)[:, m - 1]
            # all that could be among the first k once scores are exact, ties by id
            qi, xi = np.nonzero((scores >= edge[:, None] - 1e-12) & (scores > -np.inf))
            frame = pd.DataFrame({"q": q[qi], "id": ids[xi], "score": cosines(y[at + qi], x[xi])})
            found.append(frame.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q", sort=False).head(k))
        return pd.concat(found)

    keys = ["t", "cell", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(ranked, "q long, id long, score double")


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every query."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
