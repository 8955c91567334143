"""Importance resampling against a model counted in plain Python."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from linkspark.llm import importance


def buckets(text):
    return importance.ngrams([text.encode()])[1].tolist()


def test_weights_equal_the_ratio_of_two_counted_models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    said = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect()}
    raw = collections.Counter(b for t in texts.values() for b in buckets(t))
    target = collections.Counter(b for i, q in said.items() if q == 1 for b in buckets(texts[i]))
    log = lambda counts, b: math.log((counts[b] + 0.5) / (sum(counts.values()) + 0.5 * importance.BUCKETS))
    ratio = {b: log(target, b) - log(raw, b) for b in raw}
    rows = importance.resample(docs, labels).collect()
    for r in rows:
        want = sum(ratio[b] for b in buckets(texts[r["doc_id"]])) if texts[r["doc_id"]].split() else -math.inf
        assert r["log_ratio"] == want or math.isclose(r["log_ratio"], want, abs_tol=1e-6)
    k = round(len(texts) * sum(q == 1 for q in said.values()) / len(said))
    best = sorted(rows, key=lambda r: (-r["gumbel_key"], r["doc_id"]))[:k]
    assert {r["doc_id"] for r in rows if r["kept"]} == {r["doc_id"] for r in best} and k > 0


def test_gumbel_keys_draw_in_proportion(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("text"))
    ratios = np.zeros(importance.BUCKETS)
    ratios[buckets("a")] = math.log(3)
    kept = importance.top(importance.weighted(docs, ratios), 200).where("kept")
    assert 0.66 < kept.where("id % 2 = 0").count() / 200 < 0.84


def test_edges_of_the_sample(spark):
    made = [(i, f"w{i} x") for i in range(10)] + [(10 + i, "") for i in range(10)] + [(7, "same text")] * 300
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    kept = lambda d, share: importance.resample(d, labels, share=share).where("kept").collect()
    words_only, empty = docs.limit(20), docs.where("text = ''")
    assert len(kept(words_only, 15 / 20)) == 15 and {r["doc_id"] for r in kept(words_only, 15 / 20)} == {*range(15)}
    assert {r["doc_id"] for r in kept(empty, 0.3)} == {10, 11, 12}
    assert len(kept(docs, 0.5)) == 160  # repeated rows at the edge: as many as fit
    rows = importance.weighted(docs, np.zeros(importance.BUCKETS))
    assert [importance.top(rows, k, bins=3).where("kept").count() for k in (0, 5, 100, 311, 320, 999)] == [0, 5, 100, 311, 320, 320]
