"""Text within text at any size: numbers that hold a run of digits, and names that hold
the words of a file's name.

An inverted index of short substrings (grams) leads from a needle to the texts that may
hold it. A needle asks by one gram only, the one that the fewest texts have, and what
answers is verified; the postings of a gram that many texts have are dealt to PART texts
a task, and the needle goes to each of these. There are so few grams of digits (10**5) or
letters (26**4) that their counts can be sent to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

PART = 4096


def grams(text: Column, size: int) -> Column:
    """The different substrings of ``size`` characters."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.filter(F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size)))), lambda g: F.length(g) == size)


def holders(needles: DataFrame, texts: DataFrame, size: int, alphabet: str) -> DataFrame:
    """``needle, id``: the texts (``id, text``) that hold each needle of ``size`` and more
    characters of the ``alphabet``. Each needle is asked for once."""
    asked = needles.select("needle").where(F.length("needle") >= size).distinct()
    postings = texts.select("id", "text", F.explode(grams(F.col("text"), size)).alias("gram")).where(F.col("gram").rlike(f"^[{alphabet}]*$"))
    counts = F.broadcast(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    every = asked.select("needle", F.explode(grams(F.col("needle"), size)).alias("gram"))
    # a gram that no text has is the rarest: the needle then drops out
    rarest = every.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "parts")).alias("r")).where("r.n > 0")
    ask = rarest.select("needle", "r.gram", F.explode(F.sequence(F.lit(0), F.col("r.parts") - 1)).alias("part"))
    dealt = postings.join(counts, "gram").select("gram", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", "text")
    return ask.join(dealt, ["gram", "part"]).where(F.contains("text", "needle")).select("needle", "id")


def number_matches(runs: DataFrame, numbers: DataFrame, least: int = 5, suffix: int = 12) -> DataFrame:
    """``doc, id``: the numbers (``id, number``) that hold a document's run of digits
    (``doc, run``), or whose last ``suffix`` digits (all, if fewer) end the run."""
    n = numbers.select("id", F.regexp_replace("number", "[^0-9]", "").alias("text")).where(F.length("text") >= least)
    held = holders(runs.select(F.col("run").alias("needle")), n, least, "0-9")
    # an end of the run equals an end of the number: a plain join
    ends = F.transform(F.sequence(F.lit(least), F.lit(suffix)), lambda k: F.right("run", k))
    ended = runs.select("run").distinct().select("run", F.explode(F.array_distinct(ends)).alias("end")).join(n.select("id", F.right("text", F.lit(suffix)).alias("end")), "end")
    every = held.select(F.col("needle").alias("run"), "id").union(ended.select("run", "id")).distinct()
    return runs.join(every, "run").select("doc", "id").distinct()


def name_best(words: DataFrame, names: DataFrame, size: int = 4) -> DataFrame:
    """``doc, id, hits``: of the names (``id, text``) the one that holds most of a
    document's words (``doc, words``, distinct), the larger id among equals; documents
    without a hit are left out. Ids differ; words of fewer than ``size`` letters count for
    nothing.

    Documents of the same words have the same answer, and of names that hold the same
    words the one with the largest id is enough: sets of words are compared, each once, and
    not documents with names.

    Words are taken from the rarest to the most common. A name that holds none of a
    document's first j words can hold its other ones at most, so the next word is read
    only for sets whose best is not above their number. Before the last word there is
    nothing to read: names that hold no other word hit once, and of those the largest id,
    known for each word, is enough. What holds a common word is dealt to PART sets a task."""
    kind = names.schema["id"].dataType
    sets = words.select("doc", F.array_sort(F.array_distinct(F.filter("words", lambda w: F.length(w) >= size))).alias("words")).where(F.size("words") > 0)
    asked = sets.select("words").distinct()
    index = holders(asked.select(F.explode("words").alias("needle")), names, size, "a-z")
    held = index.groupBy("id").agg(F.sort_array(F.collect_list("needle")).alias("held"))
    held = written(held.groupBy("held").agg(F.max("id").alias("id")), "name-sets")
    parts = F.ceil(F.col("n") / PART).cast("int")
    of = F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")
    postings = held.select("held", "id", F.explode("held").alias("needle"))
    stats = postings.groupBy("needle").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).withColumn("parts", parts)
    dealt = written(postings.join(stats.select("needle", "parts"), "needle").select("needle", of, "held", "id"), "name-index")
    known = asked.select("words", F.explode("words").alias("needle")).join(stats, "needle")
    ranked = known.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("n", "needle", "top", "parts"))).alias("w"))
    best = written(ranked.select("words", "w", F.lit(None).cast(kind).alias("id"), F.lit(0).alias("hits")), "name-best")
    most = best.agg(F.max(F.size("w"))).first()[0] or 0
    for j in range(most):
        left, word = F.size("w") - j, F.get("w", F.lit(j))
        ask = best.where((left > 1) & (F.col("hits") <= left)).select("words", word["needle"].alias("needle"), F.explode(F.sequence(F.lit(0), word["parts"] - 1)).alias("part"))
        met = ask.join(dealt, ["needle", "part"]).select("words", "id", F.size(F.array_intersect("words", "held")).alias("hits"))
        found = met.groupBy("words").agg(F.max(F.struct("hits", "id")).alias("b"))
        last = F.when((left == 1) & (F.col("hits") <= 1), F.struct(F.lit(1).alias("hits"), word["top"].alias("id")))
        better = F.greatest(F.struct("hits", "id"), F.coalesce("b", F.struct(F.lit(0).alias("hits"), F.lit(None).cast(kind).alias("id"))), last)
        best = written(best.join(found, "words", "left").select("words", "w", better.alias("r")).select("words", "w", "r.id", "r.hits"), "name-best")
    return sets.join(best.where("hits > 0").select("words", "id", "hits"), "words").select("doc", "id", "hits")
