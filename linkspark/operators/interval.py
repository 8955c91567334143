"""Interval joins by time buckets: an equi-join that any partitioning can spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], lts: str, rts: str, lo: int, hi: int) -> DataFrame:
    """Rows with equal ``keys`` and ``rts`` within [lts + lo, lts + hi] seconds.

    Time is cut into buckets as wide as the interval; a left row looks into the two
    that its interval can touch, a right row is in one, so no pair comes twice. The
    buckets are part of the key, which also splits a hot key by time. The frames'
    columns other than ``keys`` must differ.
    """
    width = max(1, hi - lo)
    at = F.floor((F.unix_timestamp(F.col(lts).cast("timestamp")) + lo) / width)
    wide = left.withColumn("_bucket", F.explode(F.array(at, at + 1)))
    slim = right.withColumn("_bucket", F.floor(F.unix_timestamp(F.col(rts).cast("timestamp")) / width))
    gap = F.unix_timestamp(F.col(rts).cast("timestamp")) - F.unix_timestamp(F.col(lts).cast("timestamp"))
    return wide.join(slim, [*keys, "_bucket"]).where(gap.between(lo, hi)).drop("_bucket")
