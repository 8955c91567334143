"""Queries of whole answers: details of a record, cases, reports, and the small rules of
fields; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import aggregates as A
from ..operators import browse as B
from ..operators import casework as W
from ..operators import classify as C
from ..operators import ingest as I
from ..operators import patterns as P
from ..operators import reports as R
from ..operators import scoring as S
from ..shared import shared_dir
from ..sources.views import DUCK, evidence
from .core import OWNED, RATIO
from .intake import _doc_sql
from .risk import BOARD
from .story import TIMES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name, plan, sql, head: str = DUCK) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(evidence(spark, sf_dir))
    ORACLE_SQL[name] = head + (", " if head else "") + sql.lstrip().removeprefix("+")


def joined(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in arrays})


def _latest(table: str, key: str, at: str, ref: str) -> str:
    return f"""(SELECT {key}, string_agg({ref}, ',' ORDER BY r) AS ids FROM (SELECT {key}, {ref}, row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC, {ref} DESC) AS r FROM {table} WHERE {key} <> '') WHERE r <= 10 GROUP BY 1)"""


query(
    "transaction_detail",
    lambda ev: joined(B.transaction_detail(ev), "same_account", "same_name"),
    f"""owner AS (SELECT account_id, min(entity_id) AS entity_id, min(entity_name) AS entity_name, min(phone) AS phone FROM acc GROUP BY 1)
 SELECT transaction_id, t.account_id, entity_id, entity_name, phone, a.ids AS same_account, n.ids AS same_name FROM tx t LEFT JOIN owner USING (account_id)
 LEFT JOIN {_latest("tx", "account_id", "transaction_date", "transaction_id")} a USING (account_id) LEFT JOIN {_latest("tx", "counterparty_name", "transaction_date", "transaction_id")} n USING (counterparty_name)""",
)
query(
    "telecom_detail",
    lambda ev: joined(B.telecom_detail(ev), "same_msisdn"),
    f"""SELECT event_id, t.msisdn, entity_id, entity_name, s.ids AS same_msisdn FROM tel t LEFT JOIN (SELECT phone, min(entity_id) AS entity_id, min(entity_name) AS entity_name FROM ent GROUP BY 1) e ON phone = t.msisdn
 LEFT JOIN {_latest("tel", "msisdn", "event_at", "event_id")} s ON s.msisdn = t.msisdn""",
    DUCK + " ",
)
ORACLE_SQL["telecom_detail"] = ORACLE_SQL["telecom_detail"].replace(" , SELECT event_id", " SELECT event_id", 1)
query(
    "newest_telecom",
    lambda ev: B.newest_telecom(ev.tel),
    """l AS (SELECT event_type, event_id, event_at, CASE event_type WHEN 'IPDR' THEN CASE WHEN trim(msisdn) = '' THEN '—' ELSE msisdn END || ' @ ' || ip_address ELSE msisdn || ' → ' || b_party END AS label FROM tel)
 SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_at DESC, event_id DESC))::INT AS rank FROM l QUALIFY rank <= 20""",
)


# --- cases and their audit ---


def _cases(ev) -> DataFrame:
    """A case's status, and when a seed of it last acted."""
    seeds = ev.cases.select("case_id", F.explode("seed_entity_ids").alias("entity_id")).join(ev.ent.select("entity_id", F.col("phone").alias("msisdn")), "entity_id")
    at = seeds.join(ev.tel, "msisdn").groupBy("case_id").agg(F.max("event_at").alias("updated_at"))
    return at.withColumn("status", F.when(F.col("case_id") == "CASE-A", "active").otherwise("open"))


def _audit(ev) -> DataFrame:
    """An entry for each event of a seed, of two users."""
    seeds = ev.cases.select("case_id", F.explode("seed_entity_ids").alias("entity_id")).join(ev.ent.select("entity_id", F.col("phone").alias("msisdn"), "u"), "entity_id")
    rows = seeds.join(ev.tel, "msisdn")
    return rows.select("case_id", F.col("event_at").alias("timestamp"), F.concat(F.lit("user"), (F.col("u") % 3).cast("string")).alias("user"), F.concat_ws(" ", F.lit("Opened"), "event_id", F.col("duration_sec").cast("string")).alias("action"))


_AUDIT = """seeded AS (SELECT c.case_id, e.entity_id, e.entity_name, e.phone, e.u FROM cases c JOIN ent e USING (entity_id)),
 log AS (SELECT case_id, event_at AS "timestamp", 'user' || (u % 3) AS "user", 'Opened ' || event_id || ' ' || duration_sec AS action FROM seeded JOIN tel ON msisdn = phone)"""
query(
    "case_list",
    lambda ev: A.case_list(ev, _cases(ev)),
    _AUDIT
    + """, c AS (SELECT case_id, max("timestamp") AS updated_at, CASE WHEN case_id = 'CASE-A' THEN 'active' ELSE 'open' END AS status FROM log GROUP BY 1),
 a AS (SELECT case_id, count(*) AS accounts FROM cases JOIN acc USING (entity_id) GROUP BY 1), s AS (SELECT case_id, count(*) AS seeds FROM cases GROUP BY 1),
 t AS (SELECT case_id, count(*) AS transactions FROM cases JOIN acc USING (entity_id) JOIN tx USING (account_id) GROUP BY 1),
 p AS (SELECT case_id, count(*) FILTER (event_type = 'CDR') AS cdr, count(*) FILTER (event_type = 'IPDR') AS ipdr FROM seeded JOIN tel ON msisdn = phone GROUP BY 1)
 SELECT case_id, updated_at, status, accounts, seeds, transactions, cdr, ipdr, (row_number() OVER (ORDER BY updated_at DESC, case_id))::INT AS place FROM c JOIN a USING (case_id) JOIN s USING (case_id) JOIN t USING (case_id) JOIN p USING (case_id)""",
)
query(
    "case_detail",
    lambda ev: A.case_detail(ev, _audit(ev)),
    _AUDIT
    + """ SELECT case_id, 'seed' AS kind, (row_number() OVER (PARTITION BY case_id ORDER BY entity_id))::INT AS rank, entity_id AS ref, entity_name AS label FROM seeded UNION ALL
 SELECT * FROM (SELECT case_id, 'audit', (row_number() OVER (PARTITION BY case_id ORDER BY "timestamp" DESC, action))::INT AS r, "user", action FROM log) WHERE r <= 20""",
)


def _trail(ev) -> DataFrame:
    """Entries appended in two loads to a table of the shared folder, and the newest."""
    path, rows = f"{shared_dir(ev.tx.sparkSession)}/audit-{uuid.uuid4().hex}", _audit(ev)
    for user in ("user0", "user1"):
        I.append_audit(path, rows.where(F.col("user") == user))
    return I.audit(ev.tx.sparkSession.read.schema(rows.schema).parquet(path), k=100)


query("audit_trail", _trail, _AUDIT + """ SELECT * FROM log WHERE "user" <> 'user2' ORDER BY "timestamp" DESC, action LIMIT 100""")

# --- reports ---

_LINE = TIMES.replace("+own AS", ", own AS", 1) + """, line AS (SELECT entity_id, 'BANK' AS source, resolved_at AS at_time, transaction_id AS ref FROM times UNION ALL
 SELECT e.entity_id, event_type, event_at, event_id FROM tel t JOIN ent e ON t.msisdn = e.phone),
 latest AS (SELECT entity_id, count(*) AS n_events, string_agg(source || ' ' || ref, ',' ORDER BY r) AS events FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY at_time DESC, ref DESC) AS r FROM line) WHERE r <= 25 GROUP BY 1)"""


def _whole_str(ev) -> DataFrame:
    said = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return R.full_str(ev).select(
        "entity_id", "role", "total", "category", said("transfers", lambda x: F.concat_ws(" ", x["transaction_id"], x["direction"])), F.size("events").cast("long").alias("n_events"),
        said("events", lambda x: F.concat_ws(" ", x["source"], x["ref"])), "narrative",
    )


query(
    "full_str_report",
    _whole_str,
    BOARD
    + _LINE
    + """, tops AS (SELECT entity_id, string_agg(transaction_id || ' ' || direction, ',' ORDER BY r) AS transfers FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY amount DESC, transaction_id) AS r FROM own) WHERE r <= 15 GROUP BY 1)
 SELECT entity_id, role, total, category, transfers, coalesce(n_events, -1) AS n_events, events, 'Suspicious Transaction Report for ' || coalesce(nullif(entity_name, ''), entity_id) || '. Risk category: ' || category || ' (score ' || total || '/100). Observed ' || tx_count || ' bank movements, ' || cdr || ' CDR calls, ' || ipdr || ' IPDR sessions.' AS narrative
 FROM board LEFT JOIN tops USING (entity_id) LEFT JOIN latest USING (entity_id)""",
)
_RUPEES = "CASE WHEN {0} >= 1e7 THEN printf('₹%.2f', {0} / 1e7) || ' Cr' WHEN {0} >= 1e5 THEN printf('₹%.2f', {0} / 1e5) || ' L' ELSE '₹' || format('{{:,}}', round_even({0}, 0)::BIGINT) END"
query(
    "risk_narrative",
    lambda ev: W.narrative(S.profiles(ev)),
    BOARD
    + f""", fired AS (SELECT entity_id, string_agg(evidence, ', ' ORDER BY o) AS said FROM every WHERE points > 0 GROUP BY 1)
 SELECT b.entity_id, coalesce(nullif(trim(b.entity_name), ''), b.entity_id) || ': ' || b.role || '. In ' || {_RUPEES.format("b.inflow")} || ' / out ' || {_RUPEES.format("b.outflow")} || ' (' || round_even(f5.ratio * 100, 0)::BIGINT || '% pass-through, ' || b.tx_count || ' txns'
 || CASE WHEN f5.span IS NULL THEN '' ELSE ', ' || f5.span || 'd span' END || '). Indicators: ' || coalesce(said, 'none') || '. Confidence ' || floor(b.confidence * 100)::BIGINT || '%.' AS narrative FROM board b JOIN f5 USING (entity_id) LEFT JOIN fired USING (entity_id)""",
)


def _whole_dossier(ev) -> DataFrame:
    said = lambda c, *f: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[n].cast("string") for n in f])), ","), F.lit("")).alias(c)
    return R.full_dossier(ev).select("entity_id", "entity_name", said("directions", "direction", "n"), said("counterparties", "rank", "counterparty_name", "n"), said("telecom", "event_type", "n", "duration"))


query(
    "full_dossier",
    _whole_dossier,
    OWNED
    + """, d AS (SELECT entity_id, string_agg(direction || ' ' || n, ',' ORDER BY direction) AS directions FROM (SELECT entity_id, direction, count(*) AS n FROM own GROUP BY 1, 2) GROUP BY 1),
 r AS (SELECT entity_id, counterparty_name, count(*) AS n, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, sum(amount)::DOUBLE DESC, counterparty_name) AS rank FROM own WHERE counterparty_name IS DISTINCT FROM '' GROUP BY 1, 2),
 c AS (SELECT entity_id, string_agg(rank || ' ' || counterparty_name || ' ' || n, ',' ORDER BY rank) AS counterparties FROM r WHERE rank <= 10 GROUP BY 1),
 k AS (SELECT e.entity_id, event_type, count(*) AS n, coalesce(sum(duration_sec) FILTER (event_type = 'CDR'), 0)::BIGINT AS duration FROM tel JOIN ent e ON msisdn = phone GROUP BY 1, 2),
 t AS (SELECT entity_id, string_agg(event_type || ' ' || n || ' ' || duration, ',' ORDER BY event_type) AS telecom FROM k GROUP BY 1)
 SELECT entity_id, entity_name, coalesce(directions, '') AS directions, coalesce(counterparties, '') AS counterparties, coalesce(telecom, '') AS telecom FROM ent LEFT JOIN d USING (entity_id) LEFT JOIN c USING (entity_id) LEFT JOIN t USING (entity_id)""",
)
query(
    "flagged_layering",
    lambda ev: W.flagged_layering(P.rapid_layering(ev.tx)),
    RATIO.removeprefix("+")
    + """ SELECT transaction_id AS id, 'Transaction ' || transaction_id AS title, 'Outgoing/Ingoing ratio: ' || printf('%.2f', debit / credit) || ' | Credit ₹' || printf('%.2f', credit) || ' | Debit ₹' || printf('%.2f', debit) AS detail FROM r WHERE credit > 0 AND debit / credit >= 0.9""",
)

# --- rules of documents ---

_MORE = {"kyc": (("tion", 3), ("ZZ", 9)), "fir": (("the ", 1), ("er", 2)), "bank": (("Statement", 1), ("ing", 2), ("ing", 2), ("ING", 2))}
QUERIES["doc_classify_overrides"] = lambda spark, sf_dir: C.documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), keywords=C.merged_rules(_MORE))
ORACLE_SQL["doc_classify_overrides"] = _doc_sql("documents", "doc_id", "text", {k: (*rules, *[x for i, x in enumerate(_MORE.get(k, ())) if x[0].lower() not in {y[0].lower() for y in (*rules, *_MORE[k][:i]) if y[1] == x[1]}]) for k, rules in C.KEYWORDS.items()})
QUERIES["staging_inventory"] = lambda spark, sf_dir: C.inventory(C.documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("name", F.format_string("d%07d.txt", "doc_id")), "name")
ORACLE_SQL["staging_inventory"] = f"""WITH c AS ({_doc_sql("documents", "doc_id", "text")}), r AS (SELECT category, 'd' || lpad(doc_id::VARCHAR, 7, '0') || '.txt' AS name FROM c)
 SELECT category, max(n) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY name) AS k FROM r) WHERE k <= 30 GROUP BY 1"""
_BANK_FILE = """CASE WHEN k % 4 = 0 THEN 'Bank of Baroda-' WHEN k % 7 = 1 THEN 'YES-BANK_' WHEN k % 7 = 2 THEN 'kyes ' WHEN k % 9 = 3 THEN 'Central.Bank.Of.India' WHEN k % 9 = 4 THEN 'State Union ' ELSE 'SB' END || CASE WHEN u % 5 = 0 THEN 'I stmt' WHEN u % 5 = 1 THEN 'Bank' ELSE CAST(u AS {S}) END || '.pdf'"""
QUERIES["bank_guess"] = lambda spark, sf_dir: (
    spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id AS u", "CAST(event_id % 100 AS INT) AS k").selectExpr("event_id", f"{_BANK_FILE.format(S='STRING')} AS name").select("event_id", "name", C.bank_name(F.col("name"), ("Union Bank 5",)).alias("bank"))
)
_BANK_LIST = ", ".join(f"('{b}')" for b in (*C.BANKS, "Union Bank 5"))
ORACLE_SQL["bank_guess"] = f"""WITH f AS (SELECT event_id, {_BANK_FILE.format(S="VARCHAR")} AS name FROM (SELECT event_id, user_id AS u, (event_id % 100)::INT AS k FROM events)),
 n AS (SELECT DISTINCT name FROM f), m AS (SELECT name, arg_min(bank, lpad((1000 - length(bank))::VARCHAR, 6, '0') || lower(bank)) AS bank FROM n JOIN (VALUES {_BANK_LIST}) AS b(bank) ON contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(bank), '[^a-z0-9]', '', 'g')) GROUP BY 1)
 SELECT event_id, name, coalesce(bank, '_unsorted') AS bank FROM f LEFT JOIN m USING (name)"""

# --- rules of fields, over texts made of the events' numbers ---

_FIELDS = {
    "device": "CASE WHEN k % 5 = 0 THEN '35' || lpad(CAST(event_id AS {S}), 13, '0') WHEN k % 5 = 1 THEN '35-' || lpad(CAST(u AS {S}), 13, '1') || '(2)' WHEN k % 5 = 2 THEN '404' || lpad(CAST(u AS {S}), 11, '7') || ' (1) ' WHEN k % 5 = 3 THEN '' ELSE 'n/a ' || CAST(event_id AS {S}) END",
    "day": "CASE WHEN k % 6 = 0 THEN CAST(1 + u % 31 AS {S}) || '-' || CAST(1 + k % 12 AS {S}) || '-2024' WHEN k % 6 = 1 THEN ' 2023/' || CAST(1 + k % 12 AS {S}) || '/7 x' WHEN k % 6 = 2 THEN '05.11.2022 10:00' WHEN k % 6 = 3 THEN 'on 05-11-2022' WHEN k % 6 = 4 THEN '5/11/22' ELSE '' END",
    "way": "CASE WHEN k % 7 = 0 THEN 'cr' WHEN k % 7 = 1 THEN 'Debited' WHEN k % 7 = 2 THEN 'INCOMING credit' WHEN k % 7 = 3 THEN 'out' WHEN k % 7 = 4 THEN 'outgoing' WHEN k % 7 = 5 THEN 'CRDR' ELSE '' END",
    "file": "CASE WHEN k % 4 = 0 THEN '../x/FIR: ' || CAST(u AS {S}) || '?.pdf' WHEN k % 4 = 1 THEN 'a b_c-' || CAST(event_id AS {S}) || '.CSV' WHEN k % 4 = 2 THEN 'é<>|*' || repeat('n', u % 300) ELSE '/' END",
    "spent": "CASE WHEN k % 6 = 0 THEN CAST(k AS {S}) || '.0' WHEN k % 6 = 1 THEN CAST(u % 90 AS {S}) || ':' || lpad(CAST(k % 60 AS {S}), 2, '0') WHEN k % 6 = 2 THEN '1:' || lpad(CAST(u % 60 AS {S}), 2, '0') || ':' || lpad(CAST(k % 60 AS {S}), 2, '0') WHEN k % 6 = 3 THEN ' 75 ' WHEN k % 6 = 4 THEN '1:2:3:4' ELSE 'x' END",
}


def _texts(dialect: str) -> list[str]:
    return [f"{e.format(S=dialect)} AS {n}" for n, e in _FIELDS.items()]


def _fields(spark, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id AS u", "CAST(value AS DOUBLE) AS value", "CAST(event_id % 997 AS INT) AS k", "date_trunc('second', ts) AS at")
    rows = ev.selectExpr("event_id", "value", "k", "CASE WHEN k % 3 = 0 THEN date_trunc('day', at) ELSE at END AS at", *_texts("STRING"))
    c = F.col
    return rows.select(
        "event_id", X.imei(c("device")).alias("imei"), X.imsi(c("device")).alias("imsi"), X.iso_date(c("day")).alias("day"), X.shown_direction(c("way")).alias("way"), W.safe_name(c("file")).alias("file"),
        X.seconds(c("spent")).alias("spent"), X.rupees(c("value") * c("k") * c("k")).alias("rupees"), X.shown_time(c("at")).alias("shown"), X.day_fraction(F.date_trunc("day", "at"), c("k") / 1000).alias("moment"),
    )


QUERIES["field_rules"] = _fields
ORACLE_SQL["field_rules"] = f"""WITH e AS (SELECT event_id, user_id AS u, value::DOUBLE AS value, (event_id % 997)::INT AS k, date_trunc('second', ts) AS moment FROM events),
 t AS (SELECT event_id, value, k, CASE WHEN k % 3 = 0 THEN date_trunc('day', moment)::TIMESTAMP ELSE moment END AS moment, {", ".join(_texts("VARCHAR"))} FROM e),
 d AS (SELECT *, regexp_replace(regexp_replace(device, '\\([0-9]+\\)\\s*$', ''), '[^0-9]', '', 'g') AS digits, regexp_extract(day, '^\\s*([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})', ['y', 'm', 'd']) AS y, regexp_extract(day, '^\\s*([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{4}})', ['d', 'm', 'y']) AS z,
  string_split(trim(spent), ':') AS p, value * k * k AS money FROM t)
 SELECT event_id, CASE WHEN length(digits) = 15 THEN digits END AS imei, CASE WHEN length(digits) IN (14, 15) THEN digits END AS imsi,
  CASE WHEN y.y <> '' THEN y.y || '-' || lpad(y.m, 2, '0') || '-' || lpad(y.d, 2, '0') WHEN z.y <> '' THEN z.y || '-' || lpad(z.m, 2, '0') || '-' || lpad(z.d, 2, '0') END AS day,
  CASE WHEN upper(way) IN ('CR', 'IN') OR upper(way) LIKE '%CREDIT%' OR upper(way) LIKE '%INCOMING%' THEN 'CREDIT' WHEN upper(way) IN ('DR', 'OUT') OR upper(way) LIKE '%DEBIT%' OR upper(way) LIKE '%OUTGOING%' THEN 'DEBIT' ELSE upper(way) END AS way,
  left(regexp_replace(string_split(file, '/')[-1], '[^A-Za-z0-9._\\- ]+', '_', 'g'), 180) AS file,
  CASE WHEN regexp_full_match(trim(spent), '[0-9]+(\\.0+)?') THEN string_split(trim(spent), '.')[1]::INT WHEN len(p) = 3 AND regexp_full_match(trim(spent), '[0-9:]+') THEN p[1]::INT * 3600 + p[2]::INT * 60 + p[3]::INT WHEN len(p) = 2 AND regexp_full_match(trim(spent), '[0-9:]+') THEN p[1]::INT * 60 + p[2]::INT END AS spent,
  {_RUPEES.format("money")} AS rupees, CASE WHEN moment::TIME = TIME '00:00:00' THEN strftime(moment, '%d-%b-%Y') ELSE strftime(moment, '%d-%b-%Y %H:%M:%S') END AS shown, date_trunc('day', moment)::TIMESTAMP + to_seconds(round_even(k / 1000 * 86400, 0)::INT) AS moment FROM d"""

# --- cases in every state, their documents, and the hashes of sessions ---


def _states(ev) -> DataFrame:
    """The active case where one is active, where none is, and where there is no case."""
    cases = ev.cases.select("case_id", F.when(F.col("case_id") == "CASE-B", "active").otherwise("open").alias("status"))
    forms = {"one": cases, "none": cases.withColumn("status", F.lit("closed")), "empty": cases.limit(0)}
    out = None
    for name, frame in forms.items():
        part = W.active_case(frame).withColumn("form", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


query(
    "active_case_states",
    _states,
    """s AS (SELECT DISTINCT case_id, CASE WHEN case_id = 'CASE-B' THEN 'active' ELSE 'open' END AS status FROM cases)
 SELECT * FROM (SELECT case_id, status, 'one' AS form FROM s ORDER BY status <> 'active', case_id LIMIT 1) UNION ALL SELECT min(case_id), 'closed', 'none' FROM s UNION ALL SELECT 'FIR-UNASSIGNED', 'open', 'empty'""",
)
_CASE_OF = "CASE WHEN lang IN ('aa', 'en') OR source LIKE '%1' THEN 'CASE-A' WHEN lang IS NULL THEN NULL ELSE 'CASE-B' END"


def _case_texts(spark, sf_dir: str) -> DataFrame:
    """The newest documents of the active case: its language and source give a document
    to a case, the length of its text stands for when it came."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{_CASE_OF} AS case_id", "length(text) AS uploaded_at")
    ev = evidence(spark, sf_dir)
    cases = ev.cases.select("case_id", F.when(F.col("case_id") == "CASE-B", "active").otherwise("open").alias("status"))
    return W.case_documents(docs, cases)


QUERIES["case_texts"] = _case_texts
ORACLE_SQL["case_texts"] = f"SELECT doc_id, case_id, uploaded_at FROM (SELECT doc_id, {_CASE_OF} AS case_id, length(text)::INT AS uploaded_at FROM documents) WHERE case_id = 'CASE-B' ORDER BY uploaded_at DESC, doc_id LIMIT 300"


def _hashes(ev) -> DataFrame:
    from .readers import _sessions

    rows = _sessions(ev).select(F.element_at("extra", "Odd").alias("ref"), "event_hash")
    return rows.where(F.regexp_extract("ref", r"(\d+)$", 1).cast("long") % 3 < 2)


query(
    "session_hashes",
    _hashes,
    # twelve fields: five of numbers, three addresses, two dates and two clocks
    """n AS (SELECT *, split_part(event_id, '_', 2)::BIGINT % 3 AS layout, event_at + to_seconds(duration_sec) AS ended FROM tel WHERE event_type = 'IPDR')
 SELECT event_id AS ref, substr(sha256(concat_ws('|', CASE WHEN msisdn <> '' THEN msisdn WHEN layout = 0 THEN 'None' ELSE '' END, '', '', '', '', ip_address, '', '', strftime(event_at, '%Y-%m-%d'), strftime(event_at, '%H:%M:%S'),
  strftime(CASE WHEN layout = 0 THEN ended ELSE event_at END, '%Y-%m-%d'), CASE WHEN layout = 0 THEN strftime(ended, '%H:%M:%S') ELSE '00:00:00' END)), 1, 16) AS event_hash FROM n WHERE layout < 2""",
)
