"""Browsing: literal searches, pages, most recent rows, predicates for display."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from .aggregates import owned
from .order import slice_of


def holds(text: str, *columns: str) -> Column:
    """A case-insensitive search for ``text`` itself, not for a pattern."""
    return reduce(or_, [F.contains(F.lower(c), F.lit(text.lower())) for c in columns])


def entities(ent: DataFrame, text: str, seed: bool | None = None) -> DataFrame:
    found = ent.where(holds(text, "entity_id", "entity_name") | F.exists("phones", lambda p: F.contains(F.lower(p), F.lit(text.lower()))))
    return found if seed is None else found.where(F.col("is_seed") == seed)


def accounts(acc: DataFrame, text: str) -> DataFrame:
    return acc.where(holds(text, "account_id", "entity_id", "entity_name", "phone"))


def paged(df: DataFrame, columns: list[str], number: int, size: int) -> DataFrame:
    """A page in falling order of the columns."""
    size, number = min(max(size, 1), 500), max(number, 1)
    return slice_of(df, columns, (number - 1) * size, size)


def page_counts(df: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    return n.select("total", pages.alias("pages"), (pages > number).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def ledger_rows(tx: DataFrame) -> DataFrame:
    return tx.select("transaction_id", "account_id", "transaction_date", F.col("amount").cast("double").alias("amount"), "direction", F.coalesce(X.blank(F.col("counterparty_name")), F.substring("narration", 1, 60)).alias("name"), F.coalesce(X.blank(F.col("mode")), F.lit("—")).alias("mode"), X.shown_time(F.col("transaction_date")).alias("shown"))


def ledger_page(tx: DataFrame, text: str | None = None, account: str | None = None, direction: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    if text:
        tx = tx.where(holds(text, "transaction_id", "account_id", "narration", "counterparty_name", "counterparty_account", "mode"))
    if account:
        tx = tx.where(F.col("account_id") == account)
    if direction:
        tx = tx.where(F.col("direction") == direction.upper())
    return ledger_rows(paged(tx, ["transaction_date", "transaction_id"], page, size))


def telecom_rows(tel: DataFrame) -> DataFrame:
    d = F.col("duration_sec")
    return tel.select("event_id", "event_type", "msisdn", "event_at", F.when(F.col("event_type") == "IPDR", F.col("ip_address")).otherwise(F.col("b_party")).alias("party"), F.when(d >= 3600, F.concat(F.floor(d / 60).cast("string"), F.lit("m"))).otherwise(F.concat(d.cast("string"), F.lit("s"))).alias("duration"))


def telecom_page(tel: DataFrame, text: str | None = None, event_type: str | None = None, msisdn: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    if text:
        tel = tel.where(holds(text, "event_id", "msisdn", "b_party", "ip_address", "call_type"))
    if event_type:
        tel = tel.where(F.col("event_type") == event_type)
    if msisdn:
        tel = tel.where(F.col("msisdn") == msisdn)
    return telecom_rows(paged(tel, ["event_at", "event_id"], page, size))


def first_of(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def recent_tx(ev, k: int = 10) -> DataFrame:
    rows = owned(ev.tx, ev.acc).select("entity_id", "transaction_id", "transaction_date", F.col("amount").cast("double").alias("amount"))
    return first_of(rows, ["entity_id"], [F.desc("transaction_date"), F.desc("transaction_id")], k)


def recent_telecom(ev, k: int = 10) -> DataFrame:
    rows = ev.tel.join(ev.ent.select("entity_id", F.col("phone").alias("msisdn")), "msisdn").select("entity_id", "event_id", "event_at")
    return first_of(rows, ["entity_id"], [F.desc("event_at"), F.desc("event_id")], k)


def seed_accounts(ev) -> DataFrame:
    """Accounts of seeds, their own id included, each once."""
    ids = F.array_distinct(F.array_union(F.transform("accounts", lambda a: a["account_id"]), F.array("entity_id")))
    return ev.ent.where("is_seed").select("entity_id", F.explode(ids).alias("account_id"))


def case_seeds(ev) -> DataFrame:
    return ev.cases.select("case_id", F.size("seed_entity_ids").cast("long").alias("seeds"), F.array_join(F.array_sort("seed_entity_ids"), ",").alias("ids"))


def suspicious_tx(tx: DataFrame) -> DataFrame:
    return tx.where((F.col("amount") >= 100_000) | ((F.col("direction") == "DR") & (F.col("amount") >= 50_000))).select("transaction_id", "account_id", "direction", F.col("amount").cast("double").alias("amount"))


def suspicious_calls(tel: DataFrame) -> DataFrame:
    out = F.col("call_type").startswith("OUT")
    test = (out & (F.col("duration_sec") >= 300)) | (F.col("duration_sec") >= 1800) | (F.length("b_party").between(1, 4) & out)
    return tel.where((F.col("event_type") == "CDR") & test).select("event_id", "msisdn", "b_party", "duration_sec")


def same_counterparty(ev, k: int = 10) -> DataFrame:
    """Beside each transfer with a counterparty's name the k latest of that name, which
    may hold the transfer itself."""
    latest = first_of(ev.tx.where("counterparty_name <> ''").select("counterparty_name", "transaction_date", F.col("transaction_id").alias("other")), ["counterparty_name"], [F.desc("transaction_date"), F.desc("other")], k)
    return ev.tx.select("transaction_id", "counterparty_name").join(latest, "counterparty_name").select("transaction_id", "other", "rank")


def latest_ids(df: DataFrame, key: str, at: str, ref: str, k: int) -> DataFrame:
    """``key, ids``: the ids of each key's k latest rows, latest first."""
    top = first_of(df.where(F.col(key) != "").select(key, at, ref), [key], [F.desc(at), F.desc(ref)], k)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", ref))), lambda r: r[ref]).alias("ids"))


def transaction_detail(ev, k: int = 10) -> DataFrame:
    """Each transfer with the owner of its account, the k latest of the account, and the k
    latest of its counterparty's name."""
    account = latest_ids(ev.tx, "account_id", "transaction_date", "transaction_id", k).withColumnRenamed("ids", "same_account")
    name = latest_ids(ev.tx, "counterparty_name", "transaction_date", "transaction_id", k).withColumnRenamed("ids", "same_name")
    owner = ev.acc.groupBy("account_id").agg(F.min(F.struct("entity_id", "entity_name", "phone")).alias("o")).select("account_id", "o.*")
    rows = ev.tx.join(owner, "account_id", "left").join(account, "account_id", "left").join(name, "counterparty_name", "left")
    return rows.select("transaction_id", "account_id", "entity_id", "entity_name", "phone", "same_account", "same_name")


def telecom_detail(ev, k: int = 10) -> DataFrame:
    """Each event with the owner of its phone and the k latest events of the phone."""
    same = latest_ids(ev.tel, "msisdn", "event_at", "event_id", k).withColumnRenamed("ids", "same_msisdn")
    owner = ev.ent.select(F.explode("phones").alias("msisdn"), "entity_id", "entity_name").groupBy("msisdn").agg(F.min(F.struct("entity_id", "entity_name")).alias("o")).select("msisdn", "o.*")
    return ev.tel.join(owner, "msisdn", "left").join(same, "msisdn", "left").select("event_id", "msisdn", "entity_id", "entity_name", "same_msisdn")


def newest_telecom(tel: DataFrame, k: int = 20) -> DataFrame:
    """The k newest sessions and the k newest calls, with a label."""
    net = F.concat(F.coalesce(X.blank(F.col("msisdn")), F.lit("—")), F.lit(" @ "), F.coalesce("ip_address", F.lit("None")))
    call = F.concat(F.coalesce("msisdn", F.lit("None")), F.lit(" → "), F.coalesce("b_party", F.lit("None")))
    rows = tel.where(F.col("event_type").isin("CDR", "IPDR")).select("event_type", "event_id", "event_at", F.when(F.col("event_type") == "IPDR", net).otherwise(call).alias("label"))
    return first_of(rows, ["event_type"], [F.desc("event_at"), F.desc("event_id")], k)


def phone_overlap(ev) -> DataFrame:
    """How many entity phones appear in call records."""
    both = ev.ent.select("phone").intersect(ev.tel.where("event_type = 'CDR'").select(F.col("msisdn").alias("phone")))
    return both.agg(F.count(F.lit(1)).alias("phones"))
