"""Queries of kept tables: loads, a repeated batch and a purge, committed to tables in the
shared folder and read back; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..sources.tables import Tables
from ..sources.views import DUCK, evidence

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
ORDER = ["event_at", "msisdn", "b_party", "duration_sec", "call_type", "ip_address", "data_volume_up", "data_volume_down"]


def _tables(spark) -> Tables:
    return Tables(spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}")


def _loads(spark, sf_dir: str) -> DataFrame:
    """A load, one that replaces a third and adds another, the same batch again with other
    rows, and a load of everything that adds only what is missing."""
    tel = evidence(spark, sf_dir).tel.withColumn("id", F.regexp_extract("event_id", r"(\d+)$", 1).cast("long"))
    rows = lambda where: tel.where(where).drop("id")
    kept = _tables(spark)
    kept.create("telecom", rows("true").schema, ["event_id"], by={"kind": "event_type"}, buckets=16)
    kept.upsert("telecom", rows("id % 3 = 1"), ORDER, "one")
    kept.upsert("telecom", rows("id % 3 <> 0").withColumn("duration_sec", F.col("duration_sec") + 1), ORDER, "two")
    kept.upsert("telecom", rows("id % 3 = 0").withColumn("duration_sec", F.lit(-1)), ORDER, "two")
    kept.insert_missing("telecom", rows("true"), ORDER, "three")
    return kept.read("telecom").select("event_id", "event_type", "msisdn", "event_at", "b_party", "duration_sec")


QUERIES["table_loads"] = _loads
ORACLE_SQL["table_loads"] = (
    DUCK
    + f""", n AS (SELECT *, split_part(event_id, '_', 2)::BIGINT % 3 AS k FROM tel),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {", ".join(ORDER)}) AS first, row_number() OVER (PARTITION BY event_id ORDER BY {", ".join(f"{c} DESC" for c in ORDER)}) AS last FROM n)
 SELECT event_id, event_type, msisdn, event_at, b_party, CASE WHEN k = 0 THEN duration_sec ELSE duration_sec + 1 END AS duration_sec FROM r WHERE CASE WHEN k = 0 THEN first = 1 ELSE last = 1 END"""
)


def _purged(spark, sf_dir: str) -> DataFrame:
    """What a purge by the accounts and phones of the seeds leaves in two tables."""
    ev = evidence(spark, sf_dir)
    tx, tel = ev.tx.where("transaction_id is not null"), ev.tel
    kept = _tables(spark)
    for name, rows, keys in (("tx", tx, ["transaction_id", "account_id", "amount", "direction", "transaction_date"]), ("tel", tel, ["event_id", "event_at", "msisdn", "b_party"])):
        kept.create(name, rows.schema, keys, buckets=16)
        kept.insert_missing(name, rows, [c for c in rows.columns if c not in keys])
    seeds = ev.ent.where("is_seed")
    linked = {"tx": (ev.acc.where("is_seed"), ["account_id"]), "tel": (seeds.select(F.col("phone").alias("msisdn")), ["msisdn"])}
    kept.purge(linked, "doc-1")
    again = kept.purge(linked, "doc-1")
    now = kept.read("tx").agg(F.lit("tx").alias("table"), F.count(F.lit(1)).alias("rows")).union(kept.read("tel").agg(F.lit("tel"), F.count(F.lit(1))))
    return again.join(now, "table").select("table", "before", "after", "rows")


QUERIES["table_purge"] = _purged
ORACLE_SQL["table_purge"] = (
    DUCK
    + """, t AS (SELECT DISTINCT transaction_id, account_id, amount, direction, transaction_date FROM tx), c AS (SELECT DISTINCT event_id, event_at, msisdn, b_party FROM tel)
 SELECT 'tx' AS "table", count(*) AS before, count(*) FILTER (account_id NOT IN (SELECT account_id FROM acc WHERE is_seed)) AS after, count(*) FILTER (account_id NOT IN (SELECT account_id FROM acc WHERE is_seed)) AS rows FROM t
 UNION ALL SELECT 'tel', count(*), count(*) FILTER (msisdn NOT IN (SELECT phone FROM ent WHERE is_seed)), count(*) FILTER (msisdn NOT IN (SELECT phone FROM ent WHERE is_seed)) FROM c"""
)
