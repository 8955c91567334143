"""Time resolution, timelines, heatmap, bursts and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..shared import written
from . import patterns as P
from .aggregates import owned


def resolved(tx: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Ledger rows with ``resolved_at`` and ``time_source``: the statement's clock, one
    in the texts of the row, the middle telecom clock of that day, or the date alone.
    ``days`` (entity_id, day, mid, has_cdr) is joined on the rows' owner."""
    d = F.col("transaction_date")
    said = X.clock_from_text(X.clock_text(tx.columns), d)
    if days is None:
        linked, label = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    else:
        tx = tx.withColumn("day", F.to_date(d)).join(days, ["entity_id", "day"], "left").drop("day")
        linked, label = F.col("mid").cast("timestamp"), F.when(F.col("has_cdr"), "linked_cdr").otherwise("linked_ipdr")
    clock = X.has_clock(d)
    at = F.when(clock, d.cast("timestamp")).otherwise(F.coalesce(said.cast("timestamp"), linked, d.cast("timestamp")))
    source = F.when(clock, "statement").when(said.isNotNull(), "narration").when(linked.isNotNull(), label).when(d.isNotNull(), "date_only").otherwise("unknown")
    return tx.withColumn("resolved_at", at.cast("timestamp_ntz")).withColumn("time_source", source).drop("mid", "has_cdr")


def day_clocks(ev) -> DataFrame:
    """For each entity and day the upper median of its telecom clocks: events are counted
    by second, of which a day has 86 400, and the counts run up to the middle one."""
    rows = ev.tel.join(ev.ent.select("entity_id", F.col("phone").alias("msisdn")), "msisdn").where(X.has_clock(F.col("event_at")))
    at = F.date_trunc("second", "event_at").cast(ev.tel.schema["event_at"].dataType)
    per = rows.groupBy("entity_id", F.to_date("event_at").alias("day"), at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "CDR").alias("has_cdr"))
    day = Window.partitionBy("entity_id", "day")
    run = per.select("entity_id", "day", "at", "has_cdr", F.sum("n").over(day.orderBy("at")).alias("upto"), F.sum("n").over(day).alias("total"))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("at")))
    return run.groupBy("entity_id", "day").agg(middle.alias("mid"), F.bool_or("has_cdr").alias("has_cdr"))


def tx_times(ev) -> DataFrame:
    return resolved(owned(ev.tx, ev.acc), day_clocks(ev))


def shown(at: Column) -> Column:
    return F.date_format(at, "dd-MMM-yyyy HH:mm:ss")


def entity_timeline(ev, k: int = 200) -> DataFrame:
    """Bank, call and internet events of each entity, the k latest of each."""
    bank = tx_times(ev).select("entity_id", F.lit("BANK").alias("source"), F.col("resolved_at").alias("at_time"), "time_source", F.col("transaction_id").alias("ref"), F.concat("direction", F.lit(" ₹"), F.col("amount").cast("string")).alias("title"), F.coalesce(X.blank(F.col("counterparty_name")), F.col("narration")).alias("detail"))
    net = F.col("event_type") == "IPDR"
    said = ev.tel.join(ev.ent.select("entity_id", F.col("phone").alias("msisdn")), "msisdn").select("entity_id", F.col("event_type").alias("source"), F.col("event_at").alias("at_time"), F.lit("clock").alias("time_source"), F.col("event_id").alias("ref"), F.when(net, F.concat(F.lit("IPDR "), F.coalesce(X.blank(F.col("ip_address")), F.lit("session")))).otherwise(F.concat(F.lit("CDR → "), F.coalesce(X.blank(F.col("b_party")), F.lit("—")))).alias("title"), F.when(net, F.lit("internet session")).otherwise(F.concat("call_type", F.lit(" "), F.col("duration_sec").cast("string"), F.lit("s"))).alias("detail"))
    both = bank.unionByName(said)
    w = Window.partitionBy("entity_id").orderBy(F.desc("at_time"), F.desc("ref"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("shown", shown(F.col("at_time")))


def heatmap(ev) -> DataFrame:
    """Activity of each entity in each of 24 hours, empty hours included."""
    tel = ev.tel.join(ev.ent.select("entity_id", F.col("phone").alias("msisdn")), "msisdn").where(X.has_clock(F.col("event_at"))).select("entity_id", F.hour("event_at").alias("hour"))
    bank = resolved(owned(ev.tx, ev.acc)).where(F.col("time_source").isin("statement", "narration")).select("entity_id", F.hour("resolved_at").alias("hour"))
    n = tel.unionByName(bank).groupBy("entity_id", "hour").agg(F.count(F.lit(1)).alias("n"))
    grid = ev.ent.select("entity_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    out = grid.join(n, ["entity_id", "hour"], "left").na.fill(0, ["n"]).withColumn("val", F.least(F.lit(100), F.col("n") * 15))
    return out.withColumn("status", F.when((F.col("n") >= 5) | (F.col("val") > 75), "CRITICAL").when((F.col("n") >= 2) | (F.col("val") > 45), "HIGH").otherwise("NORMAL"))


def daily_bursts(ev, least: int = 3, total: int = 100_000) -> DataFrame:
    """Days on which seed accounts moved much in several transfers."""
    rows = ev.tx.join(ev.acc.where("is_seed").select("account_id"), "account_id", "left_semi")
    per = rows.groupBy(F.to_date("transaction_date").alias("day"), "account_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    g = per.groupBy("day").agg(F.sum("n").alias("transfers"), F.sum("amount").cast("double").alias("total"))
    g = g.where((F.col("transfers") >= least) & (F.col("total") >= total))
    # the six accounts that are shown, found by rank
    first = per.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy("account_id"))).where("r <= 6")
    names = first.groupBy("day").agg(F.array_join(F.array_sort(F.collect_list("account_id")), ",").alias("accounts"))
    g = g.join(names, "day")
    return g.withColumn("score", F.least(F.lit(95), 40 + F.least(F.lit(30), F.col("transfers")) + F.when(F.col("total") > 500_000, 20).otherwise(10)).cast("long"))


def episodes(ev, k: int | None = None) -> DataFrame:
    """Call-and-transfer coincidences and daily bursts, scored alike."""
    found = written(P.call_transfer_correlation(ev), "correlation")  # read for the score and for the sessions
    corr = found.join(P.nearest_session(ev, correlated=found).select("event_id", F.lit(1).alias("sessions")), "event_id", "left")
    score = F.least(F.lit(98), F.floor("score") + F.when(F.col("sessions") == 1, 8).otherwise(0)).cast("long")
    one = corr.select(F.col("event_id").alias("key"), F.lit(1).alias("calls"), F.coalesce("sessions", F.lit(0)).alias("sessions"), F.lit(1).cast("long").alias("transfers"), F.col("amount").alias("total"), score.alias("score"), (F.bround((660 - F.least(F.lit(600), F.col("delta_sec"))) / 6, 0) / 10).alias("density"))
    many = daily_bursts(ev).select(F.concat(F.lit("DAY-"), F.col("day").cast("string")).alias("key"), F.lit(0).alias("calls"), F.lit(0).alias("sessions"), "transfers", "total", "score", F.bround(F.col("transfers") / 24, 1).alias("density"))
    both = one.unionByName(many).withColumn("severity", F.when(F.col("score") >= 80, "CRITICAL").when((F.col("score") >= 60) | (F.col("calls") == 0), "HIGH").otherwise("MEDIUM"))
    kind = F.when((F.col("transfers") > 0) & (F.col("calls") + F.col("sessions") > 0), "Multi-Modal Pass-Through").when(F.col("transfers") > 0, "High-Value Transfer Burst").otherwise("Telecom Burst")
    both = both.withColumn("kind", kind)
    if k is None:
        return both
    top = both.orderBy(F.desc("score"), "key").limit(k)  # k rows are numbered, not all
    return top.withColumn("episode_id", F.format_string("EPISODE-%02d", F.row_number().over(Window.orderBy(F.desc("score"), "key"))))
