"""The evidence tables: ledger, telecom events, entities, accounts and cases.

They are derived from the table ``events``; the second text is the same in DuckDB's
dialect, as the head of every oracle. A case has its seed entities as an array, an
entity its accounts as an array of structs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EV = """
SELECT event_id, ts, user_id AS u, event_type AS et, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
       'ACC_' || lpad(CAST(user_id AS {S}), 6, '0') AS acc,
       '98' || lpad(CAST(user_id AS {S}), 8, '0') AS phone
FROM {events}"""
_TX = """
SELECT 'TX' || CAST(event_id AS {S}) AS transaction_id,
       acc || CASE WHEN u % 7 = 0 AND k % 2 = 1 THEN '_B' ELSE '' END AS account_id,
       CASE WHEN event_id % 4 = 0 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS transaction_date,
       CAST(CASE WHEN u % 11 = 0 THEN ceil(value / 5) * 5000 ELSE value * 1000 END AS DECIMAL(18,2)) AS amount,
       CASE WHEN et = 'purchase' THEN 'DR' ELSE 'CR' END AS direction,
       CASE event_id % 32 WHEN 0 THEN 'UPI/' || {f}(ts, '{dmy}') || '/PAY'
            WHEN 4 THEN 'POS AT ' || {f}(ts, '{hms}')
            WHEN 8 THEN 'IMPS-' || {f}(ts, '{ymd}') || '-REF'
            WHEN 12 THEN 'REF ' || {f}(ts, '{ymd_hms}') ELSE 'NEFT TRANSFER' END AS narration,
       CASE WHEN k % 3 = 0 THEN '' ELSE 'CP_' || CAST(CASE WHEN u % 5 = 1 AND et = 'purchase' THEN k % 2
            WHEN u % 5 = 2 AND et = 'signup' THEN k % 2 ELSE k % 20 END AS {S}) END AS counterparty_account,
       CASE WHEN k % 3 <> 0 AND k % 7 = 0 THEN '' ELSE 'Party ' || CAST(k % 20 AS {S}) END AS counterparty_name,
       CASE k % 4 WHEN 0 THEN 'UPI' WHEN 1 THEN 'NEFT' WHEN 2 THEN 'IMPS' ELSE '' END AS mode
FROM {ev} WHERE (et = 'purchase' AND u % 13 <> 0) OR (et = 'signup' AND u % 17 <> 0)"""
_TEL = """
SELECT CASE WHEN et = 'error' THEN 'IPDR_' ELSE 'CDR_' END || CAST(event_id AS {S}) AS event_id,
       CASE WHEN et = 'error' THEN 'IPDR' ELSE 'CDR' END AS event_type,
       CASE WHEN et = 'error' AND k % 9 = 0 THEN '' ELSE phone END AS msisdn,
       date_trunc('second', ts) AS event_at,
       CASE WHEN et = 'error' THEN '' WHEN k % 10 = 0 THEN '-' WHEN k % 10 = 1 THEN '' WHEN k % 10 = 2 THEN '1909'
            ELSE '97' || lpad(CAST(k AS {S}), 8, '0') END AS b_party,
       CAST(floor(value * 10) AS INT) AS duration_sec,
       CASE et WHEN 'click' THEN 'OUTGOING' WHEN 'view' THEN 'INCOMING' ELSE '' END AS call_type,
       CASE WHEN et <> 'error' THEN '' ELSE '10.' || CAST(k % 4 AS {S}) || '.' || CAST(u % 8 AS {S}) || '.' || CAST(k AS {S}) END AS ip_address,
       CASE WHEN et = 'error' THEN value ELSE CAST(0 AS DOUBLE) END AS data_volume_up,
       CASE WHEN et = 'error' THEN value * k ELSE CAST(0 AS DOUBLE) END AS data_volume_down
FROM {ev} WHERE et IN ('click', 'view', 'error')"""
_ENT = """
SELECT DISTINCT acc AS entity_id, 'Holder ' || CAST(u AS {S}) AS entity_name, u % 10 = 0 AS is_seed, phone,
       CASE WHEN u % 7 = 0 THEN acc || '_B' ELSE '' END AS second_account, u
FROM {ev}"""

_SPARK = {"S": "STRING", "f": "date_format", "dmy": "ddMMyyyyHHmmss", "hms": "HH:mm:ss", "ymd": "yyyyMMddHHmmss", "ymd_hms": "yyyyMMdd/HHmmss", "events": "{events}", "ev": "{ev}"}
_DUCK = {"S": "VARCHAR", "f": "strftime", "dmy": "%d%m%Y%H%M%S", "hms": "%H:%M:%S", "ymd": "%Y%m%d%H%M%S", "ymd_hms": "%Y%m%d/%H%M%S", "events": "events", "ev": "ev"}

#: The head of every oracle: the same tables as common table expressions.
DUCK = (
    f"WITH ev AS ({_EV.format(**_DUCK)}),\ntx AS ({_TX.format(**_DUCK)}),\ntel AS ({_TEL.format(**_DUCK)}),\nent AS ({_ENT.format(**_DUCK)}),\n"
    "acc AS (SELECT entity_id AS account_id, entity_id, entity_name, is_seed, phone FROM ent UNION ALL\n"
    "        SELECT second_account, entity_id, entity_name, is_seed, phone FROM ent WHERE second_account <> ''),\n"
    "cases AS (SELECT CASE WHEN u % 10 = 0 THEN 'CASE-A' ELSE 'CASE-B' END AS case_id, entity_id FROM ent WHERE u % 5 = 0)"
)


@dataclass(frozen=True)
class Evidence:
    """``tx`` ledger, ``tel`` telecom events, ``ent`` entities, ``acc`` one row for
    each account with its owner, ``cases`` with arrays of seed entities."""

    tx: DataFrame
    tel: DataFrame
    ent: DataFrame
    acc: DataFrame
    cases: DataFrame


def evidence(spark: SparkSession, sf_dir: str) -> Evidence:
    ev = spark.sql(_EV.format(**_SPARK), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    as_of = lambda text: spark.sql(text.format(**_SPARK), ev=ev)
    flat = as_of(_ENT)
    accounts = F.filter(F.array(F.struct(F.col("entity_id").alias("account_id")), F.struct(F.col("second_account").alias("account_id"))), lambda a: a["account_id"] != "")
    ent = flat.withColumn("accounts", accounts).withColumn("phones", F.array("phone"))
    acc = ent.select(F.explode("accounts").alias("a"), "entity_id", "entity_name", "is_seed", "phone").select("a.account_id", "entity_id", "entity_name", "is_seed", "phone")
    cases = flat.where("u % 5 = 0").groupBy(F.when(F.col("u") % 10 == 0, "CASE-A").otherwise("CASE-B").alias("case_id")).agg(F.collect_set("entity_id").alias("seed_entity_ids"))
    return Evidence(as_of(_TX), as_of(_TEL), ent, acc, cases)
