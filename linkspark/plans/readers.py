"""Queries of the readers: every layout is written from the driver's tables, as columns
of text or as lines, and read back; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import ingest as I
from ..sources import files as S
from ..sources.views import DUCK, evidence

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name, plan, sql) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(evidence(spark, sf_dir))
    ORACLE_SQL[name] = DUCK + (", " if sql.lstrip().startswith("+") else " ") + sql.lstrip().removeprefix("+")


def layout(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns by header, from SQL expressions."""
    return df.select(*[F.expr(e).cast("string").alias(h) for h, e in columns.items()])


def _accounts(ev) -> DataFrame:
    raw = layout(ev.ent, {"account_id": "entity_id", "account_holder_name": "if(u % 3 = 0, '', entity_name)", "account_number": "concat('50', phone)", "branch_ifsc": "if(u % 2 = 0, ' ', 'IFSC1')", "docx_ifsc": "'IFSC2'", "docx_layer_info": "if(is_seed, 'Layer 1', 'x')", "docx_mobile_numbers": "if(u % 4 = 0, '-', concat(phone, ', +91', phone))", "all_docx_mobile_numbers": "concat('12 ', phone)"})
    out = S.accounts(raw)
    return out.select("entity_id", "entity_name", "is_seed", F.array_join("phones", ",").alias("phones"), F.col("accounts")[0]["account_number"].alias("number"), F.col("accounts")[0]["ifsc"].alias("ifsc"))


query("read_accounts", _accounts, "SELECT entity_id, CASE WHEN u % 3 = 0 THEN entity_id ELSE entity_name END AS entity_name, is_seed, phone AS phones, '50' || phone AS number, CASE WHEN u % 2 = 0 THEN 'IFSC2' ELSE 'IFSC1' END AS ifsc FROM ent")


def _ledger(ev) -> DataFrame:
    raw = layout(ev.tx, {"transaction_id": "if(transaction_id like '%7', '', transaction_id)", "account_id": "account_id", "transaction_datetime": "date_format(transaction_date, 'dd-MM-yyyy HH:mm:ss')", "transaction_amount": "if(mode = 'UPI', '0', format_number(amount, 2))", "credit_amount": "if(direction = 'CR', amount, null)", "debit_amount": "if(direction = 'DR', amount, null)", "transaction_direction": "lower(direction)", "description": "narration", "derived_transaction_mode": "mode", "transaction_mode": "'OTHER'"})
    return S.ledger(raw).select("transaction_id", "account_id", "transaction_date", F.col("amount").cast("double").alias("amount"), "direction", "narration", "mode")


query("read_transactions", _ledger, "SELECT transaction_id, account_id, transaction_date, amount::DOUBLE AS amount, direction, narration, CASE WHEN mode = '' THEN 'OTHER' ELSE mode END AS mode FROM tx WHERE transaction_id NOT LIKE '%7'")


def _operators(ev) -> DataFrame:
    """Three operators' layouts of the call records."""
    cdr = ev.tel.where("event_type = 'CDR'").withColumn("n", F.substring_index("event_id", "_", -1).cast("long") % 3)
    day, clock = "date_format(event_at, 'dd/MM/yyyy')", "date_format(event_at, 'HH:mm:ss')"
    one = layout(cdr.where("n = 0"), {"Target A Party Number": "concat(\"'91\", msisdn, \"'\")", "B Party Number": "concat('=\"0', b_party, '\"')", "Call Date": day, "Call Initiation Time CIT": clock, "Dur(s)": "duration_sec", "Call Type": "if(call_type = 'OUTGOING', 'out', 'in')", "First CGI Lat/Long": "'12.9/77.5'", "First Cell ID": "event_id"})
    two = layout(cdr.where("n = 1"), {"Mobile No": "msisdn", "Other Party No": "concat('0', b_party)", "Date of Call": day, "CIT": clock, "Duration": "duration_sec", "Call_Type": "if(call_type = 'OUTGOING', 'OUT', 'IN')", "LAT": "'12.9'", "LNG": "'77.5'", "CGI": "event_id"})
    three = layout(cdr.where("n = 2"), {"Calling Party Telephone Number": "concat(msisdn, '.0')", "Called Party Telephone Number": "concat('0', b_party)", "DATE": day, "TIME": clock, "Call Duration": "duration_sec", "Call Type": "call_type", "Lat Long": "'12.9|77.5'", "First Cell Global Id": "event_id"})
    return S.unified_cdr(one).unionByName(S.unified_cdr(two)).unionByName(S.unified_cdr(three))


# a number of ten digits after its zero loses it, others keep it
_OTHER = "CASE WHEN length(b_party) = 10 THEN b_party WHEN b_party = '-' THEN '0-' ELSE '0' || b_party END"
query(
    "cdr_unified",
    lambda ev: _operators(ev).select("A_PARTY", "B_PARTY", "CALL_DATE", "CALL_TIME", "DURATION", "CALL_TYPE", "FIRST_CELL_ID", "LATITUDE", "LONGITUDE"),
    f"SELECT msisdn AS \"A_PARTY\", {_OTHER} AS \"B_PARTY\", strftime(event_at, '%d/%m/%Y') AS \"CALL_DATE\", strftime(event_at, '%H:%M:%S') AS \"CALL_TIME\", duration_sec::VARCHAR AS \"DURATION\", call_type AS \"CALL_TYPE\", event_id AS \"FIRST_CELL_ID\", '12.9' AS \"LATITUDE\", '77.5' AS \"LONGITUDE\" FROM tel WHERE event_type = 'CDR'",
)
query(
    "cdr_events",
    lambda ev: S.cdr_events(_operators(ev).union(_operators(ev)), "f.csv").drop("location"),
    f"SELECT 'CDR_' || upper(substr(md5(msisdn || '|' || strftime(event_at, '%d/%m/%Y').replace('/', '-') || '|' || strftime(event_at, '%H:%M:%S') || '|' || duration_sec || '|' || call_type || '|' || event_id), 1, 20)) AS event_id, 'CDR' AS event_type, msisdn, event_at, {_OTHER} AS b_party, duration_sec, call_type, event_id AS first_cell_id, 'f.csv' AS source_file FROM tel WHERE event_type = 'CDR'",
)


def _sessions(ev) -> DataFrame:
    """Three layouts of the internet sessions."""
    net = ev.tel.where("event_type = 'IPDR'").withColumn("n", F.substring_index("event_id", "_", -1).cast("long") % 3)
    day, clock = "date_format(event_at, 'dd/MM/yyyy')", "date_format(event_at, 'HH:mm:ss')"
    end = "timestampadd(SECOND, duration_sec, event_at)"
    ends = f"date_format({end}, 'dd/MM/yyyy')", f"date_format({end}, 'HH:mm:ss')"
    one = layout(net.where("n = 0"), {"IP": "'IPV4'", "VALUE": "ip_address", "F DATE": day, "F TIME": clock, "T DATE": ends[0], "T TIME": ends[1], "Mobile": "concat('+91', msisdn)", "Odd": "event_id"})
    two = layout(net.where("n = 1"), {"No.": "duration_sec", "IP Address": "ip_address", "Date": day, "Time(IST)": clock, "Username": "'u'", "Mobile": "msisdn", "Odd": "event_id"})
    long = {"Landline/MSISDN/MDN/Leased Circuit ID for Internet Access": "msisdn", "Source IP Address (IP Address assigned/Translated)": "ip_address", "Start Date of Public IP Address Allocation (dd/mm/yyyy)": day, "IST Start Time of Public IP Address Allocation (hh:mm:ss)": clock, "Session Duration": "duration_sec", "Odd": "event_id"}
    three = layout(net.where("n = 2"), long)
    return S.ipdr_events(one).unionByName(S.ipdr_events(two)).unionByName(S.ipdr_events(three))


query(
    "ipdr_layouts",
    lambda ev: _sessions(ev).select(F.element_at("extra", "Odd").alias("ref"), "msisdn", "ip_address", "event_at", F.coalesce("duration_sec", F.lit(-1)).alias("duration")),
    # no end and no duration in the second layout; an end at the start's own moment is none, but at midnight's
    """+n AS (SELECT *, split_part(event_id, '_', 2)::BIGINT % 3 AS layout FROM tel WHERE event_type = 'IPDR')
 SELECT event_id AS ref, nullif(msisdn, '') AS msisdn, nullif(ip_address, '') AS ip_address, event_at, CASE WHEN layout = 1 THEN -1 ELSE duration_sec END AS duration FROM n WHERE msisdn <> '' OR ip_address <> ''""",
)


def _unified(ev) -> DataFrame:
    net = ev.tel.where("event_type = 'IPDR'")
    raw = layout(net, {"Record Id": "if(event_id like '%3', substring(event_id, 6), event_id)", "Msisdn": "if(msisdn = '', null, concat(msisdn, '.0'))", "Ip Address": "ip_address", "Start Date": "date_format(event_at, 'dd-MM-yyyy')", "Start Time": "date_format(event_at, 'HH:mm:ss')", "Duration Sec": "duration_sec", "Data Volume Up": "format_number(data_volume_up, 2)"})
    return S.unified_sessions(raw, "f").select("event_id", "msisdn", "ip_address", "event_at", "duration_sec", F.bround("data_volume_up", 1).alias("up"))


query("ipdr_unified", _unified, "SELECT event_id, msisdn, ip_address, event_at, duration_sec, round_even(round_even(data_volume_up, 2), 1) AS up FROM tel WHERE event_type = 'IPDR'")


def _bank(ev) -> DataFrame:
    """Two layouts of the ledger: a column for each direction, and one with a type, whose
    single amount is held by the words for a credit amount and so counts as one."""
    day = "date_format(transaction_date, 'dd-MM-yyyy')"
    digits = "concat('12345678', regexp_replace(account_id, '[^0-9]', ''))"
    one = layout(ev.tx.where("direction = 'DR'"), {"Tran Date": day, "Particulars": "narration", "Withdrawal": "format_number(amount, 2)", "Deposit": "''", "A/C No": digits, "Tran Id": "transaction_id"})
    two = layout(ev.tx.where("direction = 'CR'"), {"Value Dt": day, "Narration": "narration", "Amount": "amount", "Type": "if(mode = '', '', 'C')", "AC No": digits, "Ref No": "transaction_id"})
    out = S.bank_table(one).unionByName(S.bank_table(two))
    return out.select("transaction_id", "account_id", "transaction_date", F.col("amount").cast("double").alias("amount"), "direction", "narration")


_BANK_ACCOUNT = "'ACC_' || right('12345678' || regexp_replace(account_id, '[^0-9]', '', 'g'), 12)"
query("read_bank_table", _bank, f"SELECT {_BANK_ACCOUNT} || '_' || transaction_id AS transaction_id, {_BANK_ACCOUNT} AS account_id, date_trunc('day', transaction_date)::TIMESTAMP AS transaction_date, amount::DOUBLE AS amount, direction, narration FROM tx WHERE amount > 0")


def _statements(ev) -> DataFrame:
    """A statement for each account and month, as JSON text."""
    tx = ev.tx.withColumn("month", F.date_format("transaction_date", "yyyy-MM"))
    amount = F.col("amount").cast("double")
    row = F.struct("transaction_id", F.date_format("transaction_date", "yyyy-MM-dd HH:mm:ss").alias("transaction_date"), F.when(F.col("direction") == "CR", amount).alias("credit_amount"), F.when(F.col("direction") == "DR", amount).alias("debit_amount"), F.when(F.col("mode") != "", F.col("direction")).alias("transaction_direction"), "narration", F.struct(F.col("counterparty_name").alias("name")).alias("counterparty"))
    docs = tx.groupBy("account_id", "month").agg(F.collect_list(row).alias("transactions"))
    text = F.to_json(F.struct(F.concat("account_id", F.lit("_"), "month").alias("statement_id"), F.struct("account_id").alias("account"), "transactions"))
    _, ledger = S.statements(docs.select(F.from_json(text, S.STATEMENT).alias("d")).select("d.*"))
    return ledger.select("transaction_id", "account_id", "statement_id", "transaction_date", F.col("amount").cast("double").alias("amount"), "direction", "narration", "counterparty_name")


query("read_statements", _statements, "SELECT transaction_id, account_id, account_id || '_' || strftime(transaction_date, '%Y-%m') AS statement_id, transaction_date, CASE WHEN mode = '' AND direction = 'CR' THEN 0 ELSE amount END::DOUBLE AS amount, direction, narration, counterparty_name FROM tx")


def _lines(ev) -> DataFrame:
    """A statement in lines for each account and week: entries with a balance, and noise."""
    from pyspark.sql import Window

    tx = ev.tx.withColumn("doc", F.concat_ws("#", "account_id", F.date_format(F.date_trunc("week", "transaction_date"), "yyyyMMdd")))
    order = Window.partitionBy("doc").orderBy("transaction_date", "transaction_id")
    signed = F.when(F.col("direction") == "CR", F.col("amount")).otherwise(-F.col("amount"))
    tx = tx.withColumn("line_no", 2 * F.row_number().over(order)).withColumn("balance", F.lit(500_000_000) + F.sum(signed).over(order))
    money = lambda c: F.format_number(c, 2)
    entry = F.concat_ws(" ", F.date_format("transaction_date", "dd-MM-yyyy"), F.lit("NEFT TRANSFER"), money(F.col("amount")), F.concat(money(F.col("balance")), F.lit("Cr")))
    noise = F.concat_ws(" ", F.date_format("transaction_date", "dd-MM-yyyy"), F.lit("Page Total 1.00 2.00Cr"))
    lines = tx.select("doc", "line_no", entry.alias("value")).union(tx.select("doc", F.col("line_no") + 1, noise))
    return S.statement_lines(lines).select("doc", "line_no", "transaction_date", F.col("amount").cast("double").alias("amount"), "direction", "narration")


query(
    "read_statement_lines",
    _lines,
    """+d AS (SELECT *, account_id || '#' || strftime(date_trunc('week', transaction_date), '%Y%m%d') AS doc FROM tx),
 n AS (SELECT *, (2 * row_number() OVER (PARTITION BY doc ORDER BY transaction_date, transaction_id))::INT AS line_no FROM d)
 SELECT doc, line_no, date_trunc('day', transaction_date)::TIMESTAMP AS transaction_date, amount::DOUBLE AS amount, CASE WHEN line_no = 2 THEN 'DR' WHEN direction = 'CR' AND amount > 0 THEN 'CR' ELSE 'DR' END AS direction, 'NEFT TRANSFER' AS narration FROM n WHERE amount > 0""",
)


def _hints(ev) -> DataFrame:
    hints = ev.ent.select(F.concat(F.lit("f"), F.col("u").cast("string")).alias("doc"), F.concat(F.lit("A/c No: 9"), F.right("phone", F.lit(9)), F.lit(" x "), F.lpad(F.col("u").cast("string"), 8, "0")).alias("text"))
    return I.account_matches(hints, ev.ent.select(F.col("entity_id").alias("account_id"), F.col("phone").alias("account_number")))


query("account_hints", _hints, "SELECT DISTINCT 'f' || a.u AS doc, b.entity_id AS account_id FROM ent a JOIN ent b ON a.phone = b.phone")


def _names(ev) -> DataFrame:
    files = ev.ent.select(F.col("entity_id").alias("doc"), F.concat(F.lit("statement-HOLDER-nov-"), F.col("u").cast("string"), F.lit(".pdf")).alias("name"))
    return I.name_matches(files, ev.ent.select("entity_id", "entity_name")).select("doc", "hits")


query("name_hints", _names, "SELECT entity_id AS doc, 1::BIGINT AS hits FROM ent")


def _resolved(ev) -> DataFrame:
    """What each of a file's signs says, by rows of the ledger."""
    n = F.substring("transaction_id", 3, 20).cast("long") % 7
    none = F.lit(None).cast("string")
    said = lambda k, v: F.when(n == k, F.lit(v))
    json = F.when(n == 1, F.lit('{"account":{},"transactions":[]}')).otherwise(F.lit('{"account":1}'))
    core = F.when(n == 2, F.lit("Tran Id,Tran Date,Dr Amt")).otherwise(F.lit("Tran Id"))
    header = F.when(n == 3, "cdr").otherwise("quarantine")
    out = C.resolve(said(0, "kyc"), C.statement_json(json), C.core_banking(core), header, F.coalesce(said(4, "fir"), F.lit("other")), F.lit(0.5), F.coalesce(said(5, "ipdr"), none))
    return ev.tx.select("transaction_id", out.alias("r")).select("transaction_id", "r.category", "r.confidence", C.ingest_kind(F.col("r.category")).alias("kind"))


query(
    "classify_precedence",
    _resolved,
    """+n AS (SELECT transaction_id, substr(transaction_id, 3)::BIGINT % 7 AS n FROM tx)
 SELECT transaction_id, CASE n WHEN 0 THEN 'kyc' WHEN 1 THEN 'bank' WHEN 2 THEN 'bank' WHEN 3 THEN 'cdr' WHEN 4 THEN 'fir' WHEN 5 THEN 'ipdr' ELSE 'quarantine' END AS category,
 CASE n WHEN 0 THEN 1e0 WHEN 1 THEN 92e-2 WHEN 2 THEN 9e-1 WHEN 3 THEN 88e-2 WHEN 4 THEN 5e-1 WHEN 5 THEN 65e-2 ELSE 0e0 END AS confidence,
 CASE n WHEN 1 THEN 'BANK' WHEN 2 THEN 'BANK' WHEN 3 THEN 'CDR' WHEN 5 THEN 'IPDR' ELSE 'DOCUMENT' END AS kind FROM n""",
)


def _picked(ev, pick) -> DataFrame:
    """Files of three rows, a line of text, a header and numbers, by rows of the ledger."""
    head = F.when(F.substring("transaction_id", 3, 20).cast("long") % 2 == 0, F.array(*map(F.lit, ("IP", "VALUE", "F Date", "Odd")))).otherwise(F.array(*map(F.lit, ("MSISDN", "Ip_Address", "Start Time"))))
    rows = ev.tx.select(F.col("transaction_id").alias("path"), F.posexplode(F.array(F.array(F.lit("Report of"), F.lit("a case")), head, F.array(F.lit("1"), F.lit("2.5")))).alias("line_no", "cells"))
    return pick(rows)


query("header_row", lambda ev: _picked(ev, C.header_row), "SELECT transaction_id AS path, 1 AS line_no, CASE WHEN substr(transaction_id, 3)::BIGINT % 2 = 0 THEN 2 ELSE 3 END AS score FROM tx")
query("session_header_row", lambda ev: _picked(ev, S.best_header), "SELECT transaction_id AS path, 1 AS line_no, CASE WHEN substr(transaction_id, 3)::BIGINT % 2 = 0 THEN 3 ELSE 2 END AS hits FROM tx")


def _again(ev) -> DataFrame:
    n = F.substring("transaction_id", 3, 20).cast("long")
    kind = F.when(n % 3 == 0, "accounts").when(n % 3 == 1, "cdr").otherwise("other")
    sniffed = F.when(n % 5 == 0, "cdr").when(n % 5 == 1, "bank").otherwise("quarantine")
    name = F.when(n % 11 == 0, "x 9812345678.csv").when(n % 11 == 1, "my ledger.pdf").otherwise("a.csv")
    return ev.tx.select("transaction_id", C.resniffed(kind, F.lit(""), sniffed, name).alias("load_as"))


query(
    "resniff",
    _again,
    """+n AS (SELECT transaction_id, substr(transaction_id, 3)::BIGINT AS n FROM tx)
 SELECT transaction_id, CASE WHEN n % 11 = 0 THEN 'cdr' WHEN n % 11 <> 1 AND n % 5 = 0 THEN 'cdr' WHEN n % 11 <> 1 AND n % 5 = 1 AND n % 3 <> 1 THEN 'bank_statement'
 WHEN n % 3 = 0 THEN 'bank_statement' WHEN n % 3 = 1 THEN 'cdr' WHEN n % 11 = 1 THEN 'bank_statement' END AS load_as FROM n""",
)
