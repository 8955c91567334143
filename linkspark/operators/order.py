"""Order statistics without a task that holds the order: a page far into a table, and the
rank of a value among all, by counts of ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a round, rows of the sample that they are cut from, and rows that are few
#: enough to be sorted by one task.
RANGES, SAMPLE, FEW = 64, 20_000, 100_000


def _cuts(df: DataFrame, columns: list[str], rows: int) -> list:
    """Up to RANGES - 1 different keys that cut a table of so many rows evenly."""
    keys = df.select(*columns)
    some = keys if rows <= SAMPLE else keys.sample(SAMPLE / rows, seed=rows)
    found = some.select(F.struct(*columns).alias("k")).orderBy("k").limit(2 * SAMPLE).collect()
    step = max(1, len(found) // RANGES)
    return list(dict.fromkeys(r["k"] for r in found[step::step]))[: RANGES - 1]


def _below(df: DataFrame, columns: list[str], cut) -> Column:
    """Whether a row's key is below ``cut``, nulls first."""
    out = F.lit(False)
    for c in reversed(columns):
        value = F.lit(cut[c]).cast(df.schema[c].dataType)
        lower = F.lit(False) if cut[c] is None else F.col(c).isNull() | (F.col(c) < value)
        out = F.coalesce(lower, F.lit(False)) | (F.col(c).eqNullSafe(value) & out)
    return out


def slice_of(df: DataFrame, columns: list[str], offset: int, limit: int, descending: bool = True) -> DataFrame:
    """The rows ``offset`` to ``offset + limit`` in the order of the columns. Rounds of
    counts narrow the table to the ranges that the slice meets, until few rows are left;
    a range of one key, whose rows have no order, is not narrowed further."""
    rows = df.count()
    if offset >= rows or limit < 1:
        return df.limit(0)
    while rows > FEW:
        cuts = _cuts(df, columns, rows)
        lower = [_below(df, columns, c) for c in cuts]
        part = sum((1 - x.cast("int") for x in lower), F.lit(0))
        counted = {r["part"]: r["count"] for r in df.groupBy(part.alias("part")).count().collect()}  # RANGES rows at most
        first, upto, kept = None, 0, []
        for k in sorted(counted, reverse=descending):
            if upto < offset + limit and upto + counted[k] > offset:
                first = upto if first is None else first
                kept.append(k)
            upto += counted[k]
        inside = sum(counted[k] for k in kept)
        if inside == rows:
            break
        df, offset, rows = df.where(part.isin(*kept)), offset - first, inside
    way = F.desc if descending else F.asc
    return df.orderBy(*[way(c) for c in columns]).offset(offset).limit(limit)


def after(df: DataFrame, columns: list[str], key: dict, limit: int, descending: bool = True) -> DataFrame:
    """The ``limit`` rows that follow a key: the next page, whatever came before it."""
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(key[c]).cast(df.schema[c].dataType)) for c in columns])
    low = _below(df, columns, key)
    way = F.desc if descending else F.asc
    return df.where(low if descending else ~low & ~same).orderBy(*[way(c) for c in columns]).limit(limit)


def shares(values: DataFrame, norms: DataFrame, ranges: int = 128) -> DataFrame:
    """``measure, value, share``: for each different value the share of the norms
    (measure, value, n) that are not above it. Equal values are one row before anything
    is ordered; different ones are cut into ranges of equal counts, which are summed
    first and ordered each alone."""
    both = norms.select("measure", "value", "n").unionByName(values.select("measure", "value", F.lit(0).cast("long").alias("n")))
    single = both.groupBy("measure", "value").agg(F.sum("n").alias("n"))
    cuts = single.groupBy("measure").agg(F.percentile_approx("value", [k / ranges for k in range(1, ranges)], 100 * ranges).alias("cuts"))
    dealt = single.join(F.broadcast(cuts), "measure").select("measure", "value", "n", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("part"))
    sums = dealt.groupBy("measure", "part").agg(F.sum("n").alias("n"))
    lower = Window.partitionBy("measure").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("measure", "part", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("measure")).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("measure", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.withColumn("upto", upto).join(F.broadcast(sums), ["measure", "part"])  # so many rows as ranges and measures
    return found.select("measure", "value", F.when(F.col("total") > 0, (F.col("before") + F.col("upto")) / F.col("total")).otherwise(0.0).alias("share"))
