"""Findings and reports: compositions of the detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from . import aggregates as A
from . import patterns as P
from . import scoring as S
from . import timeline as T
from .aggregates import owned


def board_of(ev) -> DataFrame:
    """The leaderboard's rows as a table in the shared folder: one for each entity, read
    several times, and a wall that filters on a score's many expressions do not pass."""
    return written(S.leaderboard(S.profiles(ev)), "leaderboard")


def findings(ev) -> DataFrame:
    """One row for each kind of finding that the case has."""
    row = lambda df, kind, severity, confidence, amount, subject: df.select(F.lit(kind).alias("pattern"), severity.alias("severity"), confidence.cast("long").alias("confidence"), amount.cast("double").alias("amount"), subject.alias("subject"))
    lit = F.lit
    seeds = A.seed_convergence(ev.tx, ev.acc).orderBy(F.desc("sources"), F.desc("amount"), "dest").limit(1)
    board = board_of(ev).where("role = 'INTERMEDIARY MULE' and category in ('HIGH', 'CRITICAL') and inflow >= 50000 and tx_count between 3 and 250")
    mules = board.orderBy(F.desc("total"), F.desc("confidence"), F.desc("inflow"), "entity_id").limit(4).agg(F.count(lit(1)).alias("n"), F.sum("inflow").alias("amount"), F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("who")).where("n > 0")
    corr = P.call_transfer_correlation(ev).agg(F.count(lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount")).where("n > 0")
    hub = A.fan_in_hubs(ev.tx, k=1)
    smurf = A.structuring(ev.tx).orderBy(F.desc("n"), F.desc("total"), "account_id").limit(1)
    net = A.ipdr_totals(ev.tel).where("total > 0")
    rows = [
        row(seeds, "Multi-Seed Convergence", lit("CRITICAL"), lit(95), F.col("amount"), F.col("dest")),
        row(mules, "Rapid Pass-Through Layering", lit("CRITICAL"), lit(92), F.col("amount"), F.col("who")),
        row(corr, "Cross-Dataset Coincidence", F.when(F.col("n") >= 3, "CRITICAL").otherwise("HIGH"), F.least(lit(98), 70 + F.col("n")), F.col("amount"), F.concat(F.col("n").cast("string"), lit(" coincidences"))),
        row(hub, "Gather-Scatter Hub", lit("HIGH"), lit(85), F.col("amount"), F.col("dest")),
        row(smurf, "Smurfing / Structuring", lit("HIGH"), lit(87), F.col("total"), F.col("account_id")),
        row(net, "IPDR Presence", lit("MEDIUM"), lit(75), lit(0), F.concat(F.col("total").cast("string"), lit(" sessions"))),
    ]
    return reduce(DataFrame.unionByName, rows)


def str_report(ev, k: int = 15) -> DataFrame:
    """For each entity its profile and its k largest transfers in one row."""
    p = board_of(ev).select("entity_id", "role", "total", "category")
    w = Window.partitionBy("entity_id").orderBy(F.desc("amount"), "transaction_id")
    top = owned(ev.tx, ev.acc).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    top = top.groupBy("entity_id").agg(F.count(F.lit(1)).alias("listed"), F.sum("amount").cast("double").alias("listed_amount"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "transaction_id"))), lambda x: x["transaction_id"]), ",").alias("transfers"))
    return p.join(top, "entity_id", "left")


def full_str(ev, k: int = 15, events: int = 25) -> DataFrame:
    """For each entity the whole report: profile, its k largest transfers, its latest
    events of every kind, and the narrative."""
    said = S.profiles(ev).select("entity_id", "entity_name", "role", "total", "category", "tx_count", "cdr", "ipdr")
    top = top_of(owned(ev.tx, ev.acc), [F.desc("amount"), "transaction_id"], k, F.struct("transaction_id", F.col("amount").cast("double").alias("amount"), "direction")).withColumnRenamed("top", "transfers")
    line = T.entity_timeline(ev, events)
    latest = line.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "at_time", "ref", "title"))).alias("events"))
    text = F.concat(
        F.lit("Suspicious Transaction Report for "), F.coalesce(F.nullif("entity_name", F.lit("")), "entity_id"), F.lit(". Risk category: "), "category", F.lit(" (score "), F.col("total").cast("string"),
        F.lit("/100). Observed "), F.col("tx_count").cast("string"), F.lit(" bank movements, "), F.col("cdr").cast("string"), F.lit(" CDR calls, "), F.col("ipdr").cast("string"), F.lit(" IPDR sessions."),
    )
    return said.join(top, "entity_id", "left").join(latest, "entity_id", "left").withColumn("narrative", text)


def top_of(rows: DataFrame, order: list, k: int, what) -> DataFrame:
    """``entity_id, top``: of each entity its k first rows by ``order``, as an array."""
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))).where(F.col("r") <= k)
    return first.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", what.alias("x")))), lambda p: p["x"]).alias("top"))


def full_dossier(ev, k: int = 10) -> DataFrame:
    """For each entity its sums by direction, its k most frequent counterparties, and its
    telecom sums by kind, each an array."""
    d = A.by_direction(ev).groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("direction", "n", "total"))).alias("directions"))
    c = A.top_counterparties(ev, k).groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("rank", "counterparty_name", "n", "total"))).alias("counterparties"))
    t = A.telecom_by_type(ev).groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("event_type", "n", "duration"))).alias("telecom"))
    return ev.ent.select("entity_id", "entity_name").join(d, "entity_id", "left").join(c, "entity_id", "left").join(t, "entity_id", "left")


def dossier(ev) -> DataFrame:
    """For each entity: ledger sums by direction, telecom counts, first counterparty."""
    d = A.by_direction(ev).groupBy("entity_id").agg(F.sum(F.when(F.col("direction") == "CR", F.col("total"))).alias("credit"), F.sum(F.when(F.col("direction") == "DR", F.col("total"))).alias("debit"), F.sum("n").alias("transactions"))
    t = A.telecom_by_type(ev).groupBy("entity_id").agg(F.sum(F.when(F.col("event_type") == "CDR", F.col("n"))).alias("cdr"), F.sum(F.when(F.col("event_type") == "IPDR", F.col("n"))).alias("ipdr"))
    c = A.top_counterparties(ev, 1).select("entity_id", F.col("counterparty_name").alias("first_counterparty"))
    return ev.ent.select("entity_id", "is_seed").join(d, "entity_id", "left").join(t, "entity_id", "left").join(c, "entity_id", "left")


def preset(ev, name: str, **rules) -> DataFrame:
    """A detector by name, with its rule settings beside each row."""
    run = {"rapid_layering": lambda: P.rapid_layering(ev.tx, **rules), "convergence_48h": lambda: P.convergence(ev.tx, ev.acc, **rules), "call_before_transfer": lambda: P.call_before_transfer(ev, **rules)}[name]
    said = ", ".join(f"{k}={v}" for k, v in sorted(rules.items()))
    return run().withColumn("preset", F.lit(name)).withColumn("rules", F.lit(said))
