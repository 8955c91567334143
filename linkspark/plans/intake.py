"""Queries of ingest and classification over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import ingest as I
from ..sources import files as S
from ..sources.views import DUCK, evidence

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name, plan, sql, head: bool = True) -> None:
    QUERIES[name] = plan
    ORACLE_SQL[name] = (DUCK + ", " + sql.lstrip().removeprefix("+")) if head and sql.lstrip().startswith("+") else (DUCK + " " + sql if head else sql)


def _ledger(spark, sf_dir):
    """A date-only ledger whose key (order, line) is not unique."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.concat(F.lit("ACC_"), F.col("o_custkey").cast("string")).alias("account_id"), F.col("l_suppkey").cast("string").alias("party"), F.col("l_extendedprice").cast("double").alias("amount"), F.when(F.col("l_returnflag") == "R", "CR").otherwise("DR").alias("direction"))


LEDGER = "led AS (SELECT l_orderkey, l_linenumber, 'ACC_' || o_custkey AS account_id, l_suppkey::VARCHAR AS party, l_extendedprice::DOUBLE AS amount, CASE WHEN l_returnflag = 'R' THEN 'CR' ELSE 'DR' END AS direction FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
ORDER = ["amount", "party", "direction"]
LAST = "QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {}) = 1"


def _halves(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    return led.where("l_orderkey % 3 <> 0"), led.where("l_orderkey % 3 <> 1")


def _cdr(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    c = ev.tel.where("event_type = 'CDR'")
    return c.select("event_id", S.stable_cdr_id(F.col("msisdn"), F.date_format("event_at", "yyyy-MM-dd"), F.date_format("event_at", "HH:mm:ss"), F.col("duration_sec").cast("string"), F.col("call_type"), F.lit("")).alias("stable_id"))


def _loads(spark, sf_dir):
    """Every entity twice, the second time with other fields blank."""
    ent = evidence(spark, sf_dir).ent
    one = ent.select("entity_id", F.lit(1).alias("seq"), "is_seed", "entity_name", F.lit("").alias("pan"), "phones", "accounts")
    two = ent.select("entity_id", F.lit(2).alias("seq"), F.lit(False).alias("is_seed"), F.lit("").alias("entity_name"), F.concat(F.lit("PAN"), F.col("u").cast("string")).alias("pan"), F.array(F.concat(F.lit("+91"), F.col("phone"))).alias("phones"), "accounts")
    return one.unionByName(two)


def _sessions(spark, sf_dir):
    t = evidence(spark, sf_dir).tel.where("event_type = 'IPDR'")
    return t.select("ip_address", "event_id", F.nullif("msisdn", F.lit("")).alias("msisdn"), F.when(F.col("data_volume_up") > 50, F.col("data_volume_up")).alias("up"))


query("cdr_event_id", _cdr, "SELECT event_id, 'CDR_' || upper(substr(md5(right(msisdn, 10) || '|' || strftime(event_at, '%Y-%m-%d') || '|' || strftime(event_at, '%H:%M:%S') || '|' || duration_sec || '|' || upper(call_type) || '|'), 1, 20)) AS stable_id FROM tel WHERE event_type = 'CDR'")
query("upsert_latest", lambda s, d: I.upsert(*_halves(s, d), ["l_orderkey", "l_linenumber"], ORDER), f"WITH {LEDGER}, two AS (SELECT *, 0 AS load FROM led WHERE l_orderkey % 3 <> 0 UNION ALL SELECT *, 1 FROM led WHERE l_orderkey % 3 <> 1) SELECT * EXCLUDE (load) FROM two " + LAST.format("load DESC, amount DESC, party DESC, direction DESC"), False)
query("insert_missing", lambda s, d: I.insert_missing(*_halves(s, d), ["l_orderkey", "l_linenumber"], ORDER), f"WITH {LEDGER} SELECT * FROM led WHERE l_orderkey % 3 = 0 " + LAST.format("amount, party, direction"), False)
query("entity_merge", lambda s, d: I.merge_entities(_loads(s, d)).select("entity_id", "is_seed", "entity_name", "pan", F.array_join("phones", ",").alias("phones"), F.array_join(F.transform("accounts", lambda a: a["account_id"]), ",").alias("accounts")), "SELECT entity_id, is_seed, entity_name, 'PAN' || u AS pan, '+91' || phone || ',' || phone AS phones, CASE WHEN second_account <> '' THEN entity_id || ',' || second_account ELSE entity_id END AS accounts FROM ent")
query("ipdr_dedupe_merge", lambda s, d: I.merge_duplicates(_sessions(s, d), "ip_address", "event_id"), "SELECT ip_address, arg_min(nullif(msisdn, ''), event_id) FILTER (msisdn <> '') AS msisdn, arg_min(data_volume_up, event_id) FILTER (data_volume_up > 50) AS up, count(*) AS copies, CASE WHEN count(*) > 1 THEN 'merged' ELSE 'unique' END AS dup_status FROM tel WHERE event_type = 'IPDR' GROUP BY 1")
query("purge_by_lineage", lambda s, d: I.load_report({"tx": I.purge(evidence(s, d).tx, evidence(s, d).acc.where("is_seed"), ["account_id"]), "tel": I.purge(evidence(s, d).tel, evidence(s, d).ent.where("is_seed").select(F.col("phone").alias("msisdn")), ["msisdn"])}), 'SELECT \'tx\' AS "table", count(*) AS rows FROM tx WHERE account_id NOT IN (SELECT account_id FROM acc WHERE is_seed) UNION ALL SELECT \'tel\', count(*) FROM tel WHERE msisdn NOT IN (SELECT phone FROM ent WHERE is_seed)')
query("load_report", lambda s, d: I.load_report({"tx": evidence(s, d).tx, "tel": evidence(s, d).tel, "ent": evidence(s, d).ent}), 'SELECT \'tx\' AS "table", count(*) AS rows FROM tx UNION ALL SELECT \'tel\', count(*) FROM tel UNION ALL SELECT \'ent\', count(*) FROM ent')
query("already_loaded", lambda s, d: I.already_loaded(evidence(s, d).tel.where("event_type = 'CDR' and duration_sec >= 40"), evidence(s, d).tel.where("event_type = 'CDR'"), "msisdn"), "+h AS (SELECT msisdn, count(*) AS come, count(*) FILTER (duration_sec >= 40) AS have FROM tel WHERE event_type = 'CDR' GROUP BY 1) SELECT msisdn, come, have, have >= 9e-1 * come AS skip FROM h")
query("ingest_lineage", lambda s, d: I.lineage(evidence(s, d).tx.withColumn("source_file", F.concat(F.lit("f"), F.col("mode"))), evidence(s, d).tx.where("direction = 'DR'"), ["transaction_id"]), "SELECT 'f' || mode AS source_file, count(*) AS rows, count(DISTINCT account_id) AS accounts, count(*) FILTER (direction <> 'DR') AS added FROM tx GROUP BY 1")
query("data_quality", lambda s, d: I.profile(evidence(s, d).tx), "SELECT count(*) AS rows, count(*) FILTER (trim(counterparty_account) <> '') / count(*) AS counterparty_account, count(*) FILTER (trim(counterparty_name) <> '') / count(*) AS counterparty_name, count(*) FILTER (trim(mode) <> '') / count(*) AS mode FROM tx")


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _doc_sql(table: str, key: str, text: str, keywords: dict = C.KEYWORDS) -> str:
    norm = f"lower(trim(regexp_replace(replace(coalesce({text}, ''), chr(0), ' '), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')))"
    sums = ", ".join("(" + " + ".join(f"CASE WHEN contains(t, {_sql(p.strip())}) THEN {w} ELSE 0 END" for p, w in rules) + f")::INT AS {k}" for k, rules in keywords.items())
    return f"""WITH n AS (SELECT {key}, {norm} AS t FROM {table}), s AS (SELECT {key}, t, {sums} FROM n),
 r AS (SELECT *, greatest(fir, kyc, cctv, bank) AS best, list_sort([fir, kyc, cctv, bank], 'DESC')[2] AS second FROM s)
 SELECT {key}, fir, kyc, cctv, bank, CASE WHEN t = '' THEN 'quarantine' WHEN best < 4 OR (best - second < 2 AND second >= 4) THEN 'other' WHEN fir = best THEN 'fir' WHEN kyc = best THEN 'kyc' WHEN cctv = best THEN 'cctv' ELSE 'bank' END AS category,
 CASE WHEN t = '' OR best < 4 THEN 0e0 WHEN best - second < 2 AND second >= 4 THEN 2e-1 ELSE least(1e0, best / 16e0) END AS confidence, CASE WHEN t = '' THEN 'quarantined' ELSE 'classified' END AS status FROM r"""


query("doc_classify", lambda s, d: C.documents(s.read.parquet(f"{d}/documents.parquet")), _doc_sql("documents", "doc_id", "text"), False)
query("page_classify", lambda s, d: C.documents(s.read.parquet(f"{d}/pages.parquet"), "page_id", "html"), _doc_sql("pages", "page_id", "html"), False)
query("classify_report", lambda s, d: C.report(C.documents(s.read.parquet(f"{d}/documents.parquet"))), f"SELECT status, category, count(*) AS n FROM ({_doc_sql('documents', 'doc_id', 'text')}) GROUP BY 1, 2", False)
# header lines and file names derived from the ledger's rows
_HEAD = "CASE event_id % 6 WHEN 0 THEN 'A Party,B Party,Call Type,Call Date' WHEN 1 THEN 'Msisdn,Public IP,Data Volume Up' WHEN 2 THEN 'Tran Date,Narration,Dr Amt,Cr Amt,Balance' WHEN 3 THEN 'Name,Remark' WHEN 4 THEN 'Msisdn,A Party,k' ELSE 'UPI,Call Type,Description' END || ',' || event_type"
_FILE = "CASE event_id % 8 WHEN 0 THEN '98' || lpad(CAST(user_id AS {S}), 8, '0') || '.csv' WHEN 1 THEN 'cdr_' || CAST(user_id AS {S}) || '.csv' WHEN 2 THEN 'my ipdr.csv' WHEN 3 THEN 'accounts.csv' WHEN 4 THEN 'ICORE_STMT_123456789012.xlsx' WHEN 5 THEN 'FIR-2026-0417_20260101_010101_fir.pdf' WHEN 6 THEN 'transactions_' || CAST(user_id AS {S}) || '.csv' ELSE 'note.txt' END"
_RX = lambda rules: "(" + " + ".join(f"CASE WHEN regexp_matches(h, {_sql(p)}) THEN {w} ELSE 0 END" for p, w in rules) + ")"
query("header_classify", lambda s, d: s.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{_HEAD} AS header").select("event_id", C.header_kind(F.col("header")).alias("kind"), C.core_banking(F.col("header")).alias("core")), f"""WITH h AS (SELECT event_id, lower({_HEAD}) AS h FROM events), s AS (SELECT *, {_RX(C.HEADERS['cdr'])} AS c, {_RX(C.HEADERS['ipdr'])} AS i, {_RX(C.HEADERS['bank'])} AS b FROM h), r AS (SELECT *, greatest(c, i, b) AS best, list_sort([c, i, b], 'DESC')[2] AS second FROM s)
 SELECT event_id, CASE WHEN best < 5 THEN 'quarantine' WHEN best - second < 2 AND second >= 5 THEN CASE WHEN c >= second THEN 'cdr' WHEN i >= second THEN 'ipdr' ELSE 'bank' END WHEN c = best THEN 'cdr' WHEN i = best THEN 'ipdr' ELSE 'bank' END AS kind, ({" + ".join(f"regexp_matches(h, {_sql(p)})::INT" for p in C.CORE_BANKING)}) >= 3 AS core FROM r""", False)
query("filename_hint", lambda s, d: s.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{_FILE.format(S='STRING')} AS name").select("event_id", C.filename_kind(F.col("name")).alias("kind")), "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'cdr' WHEN 1 THEN 'cdr' WHEN 2 THEN 'ipdr' WHEN 3 THEN 'accounts' WHEN 4 THEN 'bank' WHEN 5 THEN 'fir' WHEN 6 THEN 'transactions' END AS kind FROM events", False)
