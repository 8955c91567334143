"""The one-hop graph around every entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import owned, with_destination


def _top(g: DataFrame, order: str, k: int, name: str) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy(F.desc(order), name)
    return g.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def money_links(ev, k: int = 25) -> DataFrame:
    """The k largest destinations of each entity, for display."""
    g = with_destination(owned(ev.tx, ev.acc)).where("dest is not null").groupBy("entity_id", "account_id", "dest").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"), F.array_join(F.array_sort(F.collect_set("direction")), "/").alias("directions"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("total"), "account_id", "dest")
    return g.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _telecom(ev) -> DataFrame:
    return ev.tel.join(ev.ent.select("entity_id", F.col("phone").alias("msisdn")), "msisdn")


def call_links(ev, k: int = 20) -> DataFrame:
    g = _telecom(ev).where("event_type = 'CDR' and b_party not in ('', '-')").groupBy("entity_id", "msisdn", "b_party").agg(F.count(F.lit(1)).alias("calls"), F.sum("duration_sec").alias("duration"))
    return _top(g, "calls", k, "b_party")


def ip_links(ev, k: int = 15) -> DataFrame:
    g = _telecom(ev).where("event_type = 'IPDR' and ip_address <> ''").groupBy("entity_id", "msisdn", "ip_address").agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.col("data_volume_up") + F.col("data_volume_down")).alias("volume"))
    return _top(g, "sessions", k, "ip_address")


def nodes(ev) -> DataFrame:
    """``entity_id, id, type``: each node once for each seed."""
    kinds = [
        ev.ent.select("entity_id", F.col("entity_id").alias("id"), F.lit("entity").alias("type")),
        ev.acc.select("entity_id", F.concat(F.lit("acc:"), F.col("account_id")).alias("id"), F.lit("account").alias("type")),
        ev.ent.select("entity_id", F.concat(F.lit("tel:"), F.col("phone")).alias("id"), F.lit("phone").alias("type")),
        money_links(ev).select("entity_id", F.concat(F.lit("cp:"), F.col("dest")).alias("id"), F.lit("counterparty_account").alias("type")),
        call_links(ev).select("entity_id", F.concat(F.lit("tel:"), F.col("b_party")).alias("id"), F.lit("phone").alias("type")),
        ip_links(ev).select("entity_id", F.concat(F.lit("ip:"), F.col("ip_address")).alias("id"), F.lit("ip").alias("type")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.dropDuplicates(["entity_id", "id"])


def edges(ev) -> DataFrame:
    edge = lambda df, source, target, kind, label: df.select("entity_id", source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), label.alias("label"))
    pre = lambda p, c: F.concat(F.lit(p), F.col(c))
    owns = edge(ev.acc, F.col("entity_id"), pre("acc:", "account_id"), "ownership", F.lit("owns"))
    uses = edge(ev.ent, F.col("entity_id"), pre("tel:", "phone"), "ownership", F.lit("uses"))
    pays = edge(money_links(ev), pre("acc:", "account_id"), pre("cp:", "dest"), "transaction", F.format_string("%d tx", F.col("n")))
    said = edge(call_links(ev), pre("tel:", "msisdn"), pre("tel:", "b_party"), "call", F.format_string("%d calls", F.col("calls")))
    nets = edge(ip_links(ev), pre("tel:", "msisdn"), pre("ip:", "ip_address"), "ipdr", F.format_string("%d sessions", F.col("sessions")))
    return owns.unionByName(uses).unionByName(pays).unionByName(said).unionByName(nets)


def summary(ev) -> DataFrame:
    return nodes(ev).groupBy("entity_id", "type").agg(F.count(F.lit(1)).alias("n"))


def tints(ev) -> DataFrame:
    """The colour of each entity's node, 0 to 100, from all its ledger rows,
    destinations and call partners, not only those that are drawn."""
    pairs = with_destination(owned(ev.tx, ev.acc)).groupBy("entity_id", "dest").agg(F.count(F.lit(1)).alias("n"))
    money = pairs.groupBy("entity_id").agg(F.sum("n").alias("tx"), F.count("dest").alias("cps"))
    said = _telecom(ev).where("event_type = 'CDR' and b_party not in ('', '-')").select("entity_id", "msisdn", "b_party").distinct().groupBy("entity_id").agg(F.count(F.lit(1)).alias("calls"))
    f = ev.ent.select("entity_id", "is_seed").join(money, "entity_id", "left").join(said, "entity_id", "left").na.fill(0, ["tx", "cps", "calls"])
    s = F.when(F.col("tx") >= 3, F.least(F.lit(40.0), (F.col("tx") - 2) * 1.5)).otherwise(0.0) + F.when(F.col("cps") >= 3, F.least(F.lit(30.0), (F.col("cps") - 2) * 4.0)).otherwise(0.0) + F.when(F.col("calls") >= 8, F.least(F.lit(18.0), F.col("calls") * 0.4)).otherwise(0.0)
    f = f.withColumn("s", s)
    return f.select("entity_id", "tx", "cps", "calls", F.bround(F.least(F.lit(100.0), F.col("s") + F.when(~F.col("is_seed"), 0).when(F.col("s") >= 12, 8).otherwise(3)), 1).alias("tint"))


def highlights(ev, k: int = 12) -> DataFrame:
    """The k strongest neighbours of each entity."""
    money = money_links(ev).groupBy("entity_id", F.col("dest").alias("id")).agg(F.least(F.lit(40.0), F.sum("total") / 50_000).alias("weight"))
    said = call_links(ev).select("entity_id", F.col("b_party").alias("id"), F.least(F.lit(30.0), F.col("calls") * 2.0).alias("weight"))
    nets = ip_links(ev).select("entity_id", F.col("ip_address").alias("id"), F.least(F.lit(20.0), F.col("sessions") * 1.0).alias("weight"))
    both = money.unionByName(said).unionByName(nets).withColumn("weight", F.bround("weight", 4))
    w = Window.partitionBy("entity_id").orderBy(F.desc("weight"), "id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
