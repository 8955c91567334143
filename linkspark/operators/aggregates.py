"""Aggregations over the ledger and the telecom events. Each is one or two hash
aggregations; amounts are summed as decimals and returned as doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X

TOTAL = "double"


def money(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(TOTAL)


def when_sum(test: Column, c: Column) -> Column:
    return money(F.when(test, c))


def owned(facts: DataFrame, acc: DataFrame) -> DataFrame:
    """Ledger rows with their owner."""
    return facts.join(acc.select("account_id", "entity_id"), "account_id")


def overview(ev) -> DataFrame:
    """Table sizes, seeds, and credit and debit totals, in one row."""
    cr, dr = F.col("direction") == "CR", F.col("direction") == "DR"
    tx = ev.tx.agg(F.count(F.lit(1)).alias("transactions"), F.count_if(cr).alias("credit_count"), when_sum(cr, F.col("amount")).alias("credit_total"), F.count_if(dr).alias("debit_count"), when_sum(dr, F.col("amount")).alias("debit_total"))
    tel = ev.tel.agg(F.count_if(F.col("event_type") == "CDR").alias("cdr"), F.count_if(F.col("event_type") == "IPDR").alias("ipdr"))
    ent = ev.ent.agg(F.count(F.lit(1)).alias("entities"), F.count_if("is_seed").alias("seeds"), F.sum(F.size("accounts")).alias("accounts"))
    return ent.crossJoin(tx).crossJoin(tel)  # one row each


def by_direction(ev) -> DataFrame:
    return owned(ev.tx, ev.acc).groupBy("entity_id", "direction").agg(F.count(F.lit(1)).alias("n"), money(F.col("amount")).alias("total"))


def top_counterparties(ev, k: int = 10) -> DataFrame:
    """The k most frequent names of each entity; a null name is a name, a blank is not."""
    g = owned(ev.tx, ev.acc).where(~F.col("counterparty_name").eqNullSafe("")).groupBy("entity_id", "counterparty_name").agg(F.count(F.lit(1)).alias("n"), money(F.col("amount")).alias("total"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("n"), F.desc("total"), "counterparty_name")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def telecom_by_type(ev) -> DataFrame:
    cdr = F.col("event_type") == "CDR"
    return ev.tel.join(ev.ent.select("entity_id", F.col("phone").alias("msisdn")), "msisdn").groupBy("entity_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(cdr, F.col("duration_sec"))), F.lit(0)).alias("duration"), F.coalesce(F.sum(F.when(~cdr, F.col("data_volume_up") + F.col("data_volume_down"))), F.lit(0.0)).alias("volume"))


def counterparty(account: Column, name: Column) -> Column:
    """Who counts as a counterparty in scoring: the account, or the name where the
    account is null; then placeholders are no one."""
    c = F.trim(F.coalesce(account, name))
    return F.when(~F.upper(c).isin("", "NONE", "NULL", "UNKNOWN", "NA", "-"), c)


def account_totals(tx: DataFrame) -> DataFrame:
    """The features of each account but its counterparties: one narrow row for each."""
    i, o = X.incoming(F.col("direction")), X.outgoing(F.col("direction"))
    return tx.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("tx_count"),
        when_sum(i, F.col("amount")).alias("inflow"),
        when_sum(o, F.col("amount")).alias("outflow"),
        F.count_if(i).alias("in_count"),
        F.count_if(o).alias("out_count"),
        F.min("transaction_date").alias("first_at"),
        F.max("transaction_date").alias("last_at"),
        F.count_if(X.is_round(F.col("amount"))).alias("round_count"),
    )


def party_pairs(tx: DataFrame, key: str) -> DataFrame:
    """``key, incoming, outgoing, party``: each counterparty of a key once for each
    combination of sides, which spreads a hub over many rows."""
    i, o = X.incoming(F.col("direction")), X.outgoing(F.col("direction"))
    cp = counterparty(F.col("counterparty_account"), F.col("counterparty_name"))
    sides = tx.select(key, cp.alias("party"), i.alias("incoming"), o.alias("outgoing")).where("party is not null and (incoming or outgoing)")
    return sides.groupBy(key, "party").agg(F.bool_or("incoming").alias("incoming"), F.bool_or("outgoing").alias("outgoing"))


def account_stats(tx: DataFrame) -> DataFrame:
    """The features of each account; counterparties as sorted sets, which are as long
    as an account has counterparties: scores count them (entity_stats) instead."""
    pairs = party_pairs(tx, "account_id")
    named = lambda side: F.array_sort(F.collect_list(F.when(F.col(side), F.col("party"))))
    parties = pairs.groupBy("account_id").agg(named("incoming").alias("in_parties"), named("outgoing").alias("out_parties"))
    none = F.array().cast("array<string>")
    out = account_totals(tx).join(parties, "account_id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("in_parties", "out_parties")})


def entity_stats(tx: DataFrame, acc: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Account features rolled up to owners; counterparties are counted over distinct
    pairs of owner and counterparty. ``totals``: account_totals, if at hand."""
    of = acc.select("account_id", "entity_id")
    sums = (account_totals(tx) if totals is None else totals).join(of, "account_id").groupBy("entity_id").agg(
        *[F.sum(c).alias(c) for c in ("tx_count", "inflow", "outflow", "in_count", "out_count")],
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.sum("round_count").alias("round_count"),
    )
    parties = party_pairs(owned(tx, acc), "entity_id").groupBy("entity_id").agg(F.count_if("incoming").cast("int").alias("in_parties"), F.count_if("outgoing").cast("int").alias("out_parties"))
    return sums.join(parties, "entity_id", "left").na.fill(0, ["in_parties", "out_parties"])


def telecom_stats(tel: DataFrame) -> DataFrame:
    return tel.withColumn("phone", X.norm_phone(F.col("msisdn"))).where("phone <> ''").groupBy("phone").agg(
        F.count_if(F.col("event_type") == "CDR").alias("cdr"), F.count_if(F.col("event_type") == "IPDR").alias("ipdr"), F.min("event_at").alias("first_at"), F.max("event_at").alias("last_at"))


def with_destination(tx: DataFrame) -> DataFrame:
    return tx.withColumn("dest", X.destination(F.col("counterparty_account"), F.col("counterparty_name")))


def fan_in_hubs(tx: DataFrame, sources: int = 3, k: int = 15) -> DataFrame:
    """Destinations of many accounts, the largest amounts first. Distinct sources are
    counted over (destination, account) sums, so a hot destination is spread first."""
    pairs = with_destination(tx).where("dest is not null").groupBy("dest", "account_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    hubs = pairs.groupBy("dest").agg(F.count("account_id").alias("sources"), F.sum("n").alias("transfers"), money(F.col("amount")).alias("amount"))
    return hubs.where(F.col("sources") >= sources).orderBy(F.desc("amount"), "dest").limit(k)


def seed_convergence(tx: DataFrame, acc: DataFrame, sources: int = 2) -> DataFrame:
    """Destinations that two or more seed accounts pay; if no debit leg does, all legs
    count."""
    legs = with_destination(tx.join(acc.where("is_seed").select("account_id"), "account_id", "left_semi")).where("dest is not null")
    both = legs.withColumn("variant", F.explode(F.when(X.outgoing(F.col("direction")), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
    pairs = both.groupBy("variant", "dest", "account_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    hubs = pairs.groupBy("variant", "dest").agg(F.count("account_id").alias("sources"), F.sum("n").alias("transfers"), money(F.col("amount")).alias("amount")).where(F.col("sources") >= sources)
    first = hubs.agg(F.min("variant").alias("variant"))
    return hubs.join(F.broadcast(first), "variant").drop("variant")


def structuring(tx: DataFrame, low: int = 40_000, high: int = 50_000, least: int = 3) -> DataFrame:
    return tx.where((F.col("amount") >= low) & (F.col("amount") < high)).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), money(F.col("amount")).alias("total")).where(F.col("n") >= least)


def seed_networks(ev, k: int = 20) -> DataFrame:
    """For each seed: its k largest counterparties (name, or account where the name is
    null; a blank is one of its own), how many count as high risk, and their total."""
    key = F.coalesce(F.col("counterparty_name"), F.col("counterparty_account"))
    g = ev.tx.join(ev.acc.where("is_seed").select("account_id", "entity_id"), "account_id").groupBy("entity_id", key.alias("party")).agg(F.sum("amount").alias("total"))
    top = g.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("total"), "party"))).where(F.col("r") <= k)
    n = top.groupBy("entity_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum("total").cast(TOTAL).alias("traced"))
    return n.select("entity_id", "nodes", F.least(F.lit(8), F.greatest(F.lit(1), F.floor(F.col("nodes") / 3))).cast("long").alias("high_risk"), "traced")


def money_flow(tx: DataFrame, k: int = 50) -> DataFrame:
    """The k largest flows from an account to a name (or account), with bar widths."""
    target = X.name_or_account(F.col("counterparty_account"), F.col("counterparty_name"))
    g = tx.withColumn("target", target).where("target is not null and upper(target) <> 'UNKNOWN'").groupBy(F.col("account_id").alias("source"), "target").agg(money(F.col("amount")).alias("amount"), F.count(F.lit(1)).alias("n"))
    top = g.orderBy(F.desc("amount"), "source", "target").limit(k)
    return top.withColumn("width", F.greatest(F.lit(4.0), F.bround(100 * F.col("amount") / F.max("amount").over(Window.partitionBy()), 4)))  # over k rows


def ip_sessions(tel: DataFrame, k: int = 20) -> DataFrame:
    """The k most used addresses; phones are gathered for these alone."""
    net = tel.where("event_type = 'IPDR' and ip_address <> ''")
    top = net.groupBy("ip_address").agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.desc("sessions"), "ip_address").limit(k)
    pairs = net.join(F.broadcast(top), "ip_address").groupBy("ip_address", "sessions", F.nullif("msisdn", F.lit("")).alias("phone")).agg(F.lit(1))
    return pairs.groupBy("ip_address", "sessions").agg(F.array_join(F.array_sort(F.collect_list("phone")), ",").alias("phones")).orderBy(F.desc("sessions"), "ip_address")


def phone_sessions(tel: DataFrame, k: int = 20) -> DataFrame:
    g = tel.where("event_type = 'IPDR' and msisdn <> ''").groupBy("msisdn").agg(F.count(F.lit(1)).alias("sessions"), F.bround(F.sum("data_volume_up"), 3).alias("up"), F.bround(F.sum("data_volume_down"), 3).alias("down"))
    return g.orderBy(F.desc("sessions"), "msisdn").limit(k)


def ipdr_totals(tel: DataFrame) -> DataFrame:
    return tel.where("event_type = 'IPDR'").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("msisdn") != "").alias("with_phone"), F.countDistinct("ip_address").alias("addresses"))


def case_stats(ev) -> DataFrame:
    """For each case: accounts and phones of its seeds, and the rows they lead to."""
    seeds = ev.cases.select("case_id", F.explode("seed_entity_ids").alias("entity_id"))
    acc = seeds.join(ev.acc, "entity_id").select("case_id", "account_id")
    phones = seeds.join(ev.ent.select("entity_id", "phone"), "entity_id").select("case_id", F.col("phone").alias("msisdn"))
    tx = ev.tx.join(acc, "account_id").groupBy("case_id").agg(F.count(F.lit(1)).alias("transactions"))
    tel = ev.tel.join(phones, "msisdn").groupBy("case_id").agg(F.count_if(F.col("event_type") == "CDR").alias("cdr"), F.count_if(F.col("event_type") == "IPDR").alias("ipdr"))
    base = acc.groupBy("case_id").agg(F.count(F.lit(1)).alias("accounts")).join(seeds.groupBy("case_id").agg(F.count(F.lit(1)).alias("seeds")), "case_id")
    return base.join(tx, "case_id", "left").join(tel, "case_id", "left").na.fill(0, ["transactions", "cdr", "ipdr"])


def case_list(ev, cases: DataFrame) -> DataFrame:
    """Cases (case_id, status, updated_at and others) with their sums, the one updated
    last first by ``place``."""
    place = F.row_number().over(Window.orderBy(F.desc("updated_at"), "case_id"))  # a row for each case
    return cases.join(case_stats(ev), "case_id", "left").withColumn("place", place)


def case_detail(ev, audit: DataFrame, k: int = 20) -> DataFrame:
    """``case_id, kind, rank, ref, label``: a case's seeds, and its k latest audit entries
    (case_id, timestamp, user, action)."""
    seeds = ev.cases.select("case_id", F.explode("seed_entity_ids").alias("entity_id")).join(ev.ent.select("entity_id", "entity_name"), "entity_id")
    by_case = lambda *order: F.row_number().over(Window.partitionBy("case_id").orderBy(*order))
    one = seeds.select("case_id", F.lit("seed").alias("kind"), by_case("entity_id").alias("rank"), F.col("entity_id").alias("ref"), F.col("entity_name").alias("label"))
    two = audit.select("case_id", F.lit("audit").alias("kind"), by_case(F.desc("timestamp"), "action").alias("rank"), F.col("user").alias("ref"), F.col("action").alias("label")).where(F.col("rank") <= k)
    return one.unionByName(two)


def span_days(first: Column, last: Column) -> Column:
    return F.greatest(F.lit(1), F.datediff(last, first) + 1)


def norms(tx: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """The case's distributions, over accounts: inflow and outflow above 0, and
    transactions a day. ``measure, value, n``: counts of equal values."""
    s = account_totals(tx) if totals is None else totals
    per_day = F.col("tx_count") / span_days(F.col("first_at"), F.col("last_at"))
    rows = s.select(F.explode(F.array(F.struct(F.lit("inflow").alias("measure"), F.col("inflow").alias("value")), F.struct(F.lit("outflow").alias("measure"), F.col("outflow").alias("value")), F.struct(F.lit("per_day").alias("measure"), per_day.alias("value")))).alias("x")).select("x.*")
    return rows.where("value > 0").groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
