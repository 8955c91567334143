"""Quality classifier by importance resampling.

Words and word pairs are hashed into buckets; a target model is learned from
documents labelled as good, a raw model from all documents. A document's weight is
the ratio of its probabilities in the two models, so its log weight is the sum of
log ratios over its n-grams. Gumbel noise, drawn from a hash of id and text, is
added, and the documents with the largest sums are the sample: a draw without
replacement in proportion to the weights.

The target model uses a bounded sample, the TARGET_ROWS labelled rows first in the
order of a hash. The raw model and the weights cover all documents. The sample's
size is the share of good labels times the number of documents.

Defined cases: a text without a word has log ratio -inf and comes last, by id; null
labels do not count; equal sums are ordered by id, then text; repeated rows share
weight and noise, and are kept or not together, but at the edge of the sample, where
the number of them that fits is kept; an empty table gives an empty result, a table
without a good label keeps all; other columns of the input are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, text_of
from .neardup import _SPACE, _mix

BUCKETS = 1 << 14
TARGET_ROWS = 4000
SEED = 11
#: Rows of a range of the sorted keys, of which one is ranked.
RANGE_ROWS = 500_000
ROWS = 64
U = np.uint64


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text and bucket of every word and word pair."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[joined]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.zeros(0, int), np.zeros(0, int)
    stops = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
    owner = np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), starts, "right")
    size = stops - starts
    inside = ~space
    place = np.arange(len(joined), dtype=np.int64)[inside] - np.repeat(starts, size)
    word = _mix(np.add.reduceat(_mix(joined[inside].astype(U) + U(256) * place.astype(U)), np.concatenate([[0], np.cumsum(size)[:-1]])) + size.astype(U))
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    both = _mix(word[pair] * U(3) + word[pair + 1] + U(1))
    return np.concatenate([owner, owner[pair]]), (np.concatenate([word, both]) % U(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all n-grams by bucket: summed in tasks, then over tasks."""
    only = texts.select(text_of(texts, text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                _, bucket = ngrams([x.encode() for x in batch.slice(at, ROWS).column(0).to_pylist()])
                total += np.bincount(bucket, minlength=BUCKETS)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(total[have], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for row in map_batches(only, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    smooth = lambda n: np.log((n + 0.5) / (n.sum() + 0.5 * BUCKETS))
    return smooth(target) - smooth(raw)


def weighted(docs: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """``id, h, log_ratio, gumbel_key``."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    t = text_of(docs, text)
    only = docs.select(F.col(key).alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                owner, bucket = ngrams([x.encode() for x in part.column(2).to_pylist()])
                n = np.bincount(owner, minlength=part.num_rows)
                sums = np.where(n > 0, np.bincount(owner, sent.value[bucket], part.num_rows), -np.inf)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sums, pa.float64())], names=["id", "h", "log_ratio"])

    found = map_batches(only, run, f"id {dict(only.dtypes)['id']}, h long, log_ratio double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "h"), 11).cast("double") + 0.5) / float(1 << 53)
    return found.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(uniform)))


def top(rows: DataFrame, k: int, bins: int | None = None) -> DataFrame:
    """``rows`` with ``kept``: the k first by ``gumbel_key``, largest first, then id, text
    and place. The rows, narrow ones, are sorted into ``bins`` ranges, by default of
    some RANGE_ROWS, and only the range that the k-th falls in is ranked. Equal keys go
    on over as many ranges as they need."""
    n = rows.count()
    if k >= n or k <= 0:
        return rows.withColumn("kept", F.lit(k > 0))
    order = [F.desc("gumbel_key"), F.asc("id"), F.asc("h"), F.asc("place")]
    at_least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(bins or max(at_least, n // RANGE_ROWS), *order)
    dealt = cut(dealt.withColumn("range", F.spark_partition_id()))
    before = edge = 0
    for r in dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect():  # a row for each range
        edge = r["range"]
        if before + r["n"] >= k:
            break
        before += r["n"]
    ranked = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    inside = dealt.where(F.col("range") == edge).withColumn("kept", ranked <= k - before)
    return dealt.where(F.col("range") != edge).withColumn("kept", F.col("range") < edge).unionByName(inside).drop("range", "place")


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "quality", share: float | None = None) -> DataFrame:
    """``key, log_ratio, gumbel_key, kept`` for every row of ``docs``."""
    said = labels.select(F.col(key).alias("id"), F.col(good).alias("good")).where(F.col("good").isNotNull() & F.col("id").isNotNull())
    n, n_good = said.agg(F.count(F.lit(1)), F.count_if(F.col("good") == 1)).first()
    if not n_good:
        return docs.select(F.col(key), F.lit(0.0).alias("log_ratio"), F.lit(0.0).alias("gumbel_key"), F.lit(True).alias("kept"))
    target = said.where("good = 1").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(TARGET_ROWS)
    sample = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(target), "id", "left_semi")
    ratios = log_ratios(bucket_counts(sample, "t"), bucket_counts(docs, text))
    rows = cut(weighted(docs, ratios, key, text))
    k = round(rows.count() * (share if share is not None else n_good / n))
    return top(rows, k).select(F.col("id").alias(key), "log_ratio", "gumbel_key", "kept")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's log ratio and whether the sample keeps it."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
