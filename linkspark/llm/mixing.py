"""Mixing sources to target weights by weighted fair queueing, in DataFrame
functions only.

Each source's documents are shuffled by a seeded hash and queued twice over; a
queued document finishes at its source's words so far divided by its source's
target. All queues are then merged by one range sort on that virtual time and
cut at the total budget, so every source comes near its target.

The running sums never meet in one task: a source is split into hash ranges (its
shuffled order) and virtual time into ranges of near-equal words; each range is
summed alone and offset by the totals of the ranges before it.

Defined cases: a null text has size 0; documents of size 0 are never taken; a
null source is a source of its own, ordered last; a source without words has
target 0; repeated rows are documents of their own; an empty table gives an empty
result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, cut, text_of

WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and how often a document may be used.
SHARE, REPEATS = 1.5, 2
#: Ranges of each source's shuffled order, and of virtual time up to 1.
SOURCE_RANGES, TIME_RANGES = 1024, 4096
SEED = 7


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: weights repeat over the
    sources by code point, null last; a target stops at ``repeats`` times its
    source's size and the excess is shared again by weight.

    That is the level L with sum(min(weight L, cap)) = budget: the sources in the
    order of cap / weight are capped up to a point and have weight L beyond it.
    One row per source, not per document, meets in the windows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    picks = F.array(*[F.lit(float(w)) for w in weights])
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = one.withColumn("weight", F.get(picks, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    one = one.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    one = one.withColumn("budget", F.sum("source_size").over(whole) * share)
    one = one.withColumn("rest", F.sum("weight").over(whole) - F.sum("weight").over(by_ratio) + F.col("weight"))
    one = one.withColumn("level", (F.col("budget") - F.sum("cap").over(by_ratio) + F.col("cap")) / F.col("rest"))
    # the first source in that order that its level does not fill: that level holds from it on
    one = one.withColumn("found", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    target = F.when(F.col("found").isNull() | (F.col("ratio") <= F.col("found")), F.col("cap")).otherwise(F.col("weight") * F.col("found"))
    return one.select("source", "source_size", target.alias("target"), "budget")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, text_hash, copies``: a row per
    document, ``copies`` being how often the mix takes it."""
    text = text_of(docs)
    sized = docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(f"[^{WS}]+")).cast("long").alias("size"),
        F.xxhash64(text).alias("text_hash"),
    )
    sized = cut(sized.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "text_hash", "size")))
    targets = source_targets(sized, weights, share, repeats)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    part = F.pmod(F.shiftrightunsigned("order", 32), F.lit(SOURCE_RANGES)).cast("int")
    placed = sized.withColumn("part", part)

    # how many words each range of a source starts from
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    parts = parts.select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    parts = parts.alias("p").join(targets.alias("t"), same(parts, targets)).select("p.source", "p.part", "p.start", "t.source_size", "t.target", "t.budget")
    inside = Window.partitionBy("source", "part").orderBy("order", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("so_far", F.sum("size").over(inside))
    queued = ranked.alias("r").join(parts.alias("p"), same(ranked, parts) & (ranked["part"] == parts["part"]))
    queued = queued.select("r.doc_id", "r.source", "r.size", "r.text_hash", "p.source_size", "p.target", "p.budget", (F.col("p.start") + F.col("r.so_far")).alias("place"))
    queued = cut(queued)

    # each document finishes once in every pass over its source
    passes = queued.where("size > 0 and target > 0").withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    passes = passes.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("place")) / F.col("target"))
    # ranges of near-equal words: finer than linear beyond 1, where few sources go on
    passes = passes.withColumn("range", F.floor(F.log2(F.col("finish") + 1) * TIME_RANGES))
    ahead = Window.partitionBy("lot").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = passes.groupBy("range").agg(F.sum("size").alias("words")).withColumn("lot", F.lit(0))
    ranges = ranges.select(F.col("range"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy("finish", "source", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = passes.withColumn("upto", F.sum("size").over(within)).join(ranges, "range")
    taken = merged.where(F.col("start") + F.col("upto") <= F.col("budget"))
    copies = taken.groupBy("source", "place").agg(F.count(F.lit(1)).alias("copies"))
    # a place belongs to one document with words, and perhaps to some without
    out = queued.alias("q").join(copies.alias("c"), same(queued, copies) & (queued["place"] == copies["place"]) & (queued["size"] > 0), "left")
    return out.select("q.doc_id", "q.source", "q.size", "q.source_size", "q.target", "q.text_hash", F.coalesce("c.copies", F.lit(0)).cast("int").alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    chosen = mix(docs, **how).groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    # the join and the count after it have the same keys, none of them null, so that the texts move once
    by = ["_said", "_none", "_hash"]
    said = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_said"), F.col("doc_id").isNull().alias("_none"))
    chosen = chosen.where("copies > 0").select(*said, F.col("text_hash").alias("_hash"), "copies", "rows")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *said, F.xxhash64(text_of(docs)).alias("_hash")).join(chosen, by)
    # repeated rows share their copies: each gets the even part, the first ones the rest
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(1))))
    n = F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") <= F.pmod("copies", "rows")).cast("long")
    return keyed.withColumn("n", n).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes of it."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")
