"""Incremental ingest as streams: repeated events dropped, tables kept by key, and
transfers matched with the calls before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables


def fresh(events: DataFrame, key: str = "event_id", at: str = "event_at", late: str = "1 hour") -> DataFrame:
    """Each event once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def upsert_into(stream: DataFrame, tables: Tables, name: str, order: list[str], checkpoint: str):
    """Start a stream that keeps a table by key. A micro-batch is a commit named by the
    query and its number: one that is repeated after a failure changes nothing, and a
    query with another checkpoint starts its own numbers."""

    def write(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        tables.upsert(name, batch, order, f"{query}/{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def call_then_transfer(calls: DataFrame, transfers: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Every transfer (entity_id, transaction_id, transaction_date) with each call
    (entity_id, event_id, call_at) of its entity within so many minutes before it, and
    one row with nulls for a transfer without any. A pair comes as soon as both sides are
    there; a transfer without a call once the watermarks of both have passed what could
    still match, which is also when its state goes. Rows later than ``late`` are dropped."""
    c = calls.withWatermark("call_at", late).alias("c")
    t = transfers.withWatermark("transaction_date", late).alias("t")
    near = F.expr(f"c.entity_id = t.entity_id and c.call_at < t.transaction_date and c.call_at >= t.transaction_date - interval {minutes} minutes")
    return t.join(c, near, "left_outer").select("t.entity_id", "t.transaction_id", "t.transaction_date", "c.event_id", "c.call_at")
