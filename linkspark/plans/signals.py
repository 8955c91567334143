"""Queries of what files say of themselves, with several signs at once, near-ties, ties and
nothing: uploads with a name, a header and a text, and files with rows; and their SQL, which
reads the same texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify as C
from ..sources import files as S
from .intake import _RX, _sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _pick(words: tuple, number: str) -> str:
    """One of some texts by a number, in both dialects."""
    return f"CASE ({number}) % {len(words)} " + " ".join(f"WHEN {i} THEN {_sql(w)}" for i, w in enumerate(words)) + " END"


_NAMES = ("9812345678", "cdr dump", "my ipdr", "accounts_all", "transactions", "ICORE", "bank of x", "FIR-2026-0417_20260101_010101_scan", "the fir copy", "stmt", "note", "x 123456789012", "20260101_010101_9812345678", "recording", "first information")
_ENDINGS = ("csv", "xlsx", "pdf", "txt", "json", "zip", "tsv", "jpg", "CSV", "docx", "tiff")
_CELLS = ("A Party", "B Party", "Call Type", "Msisdn", "Public IP", "Data Volume Up", "Tran Date", "Narration", "Dr Amt", "Balance", "UPI", "Description", "Tran Id", "Remark", "Duration", "IMEI", "Ac No", "Debit", "k", "Session Duration", "Cr")
_PHRASES = ("fir no 7", "the accused", "aadhaar", "pan card", "cctv", "camera", "upi", "neft", "opening balance", "hello", "passport no", "u/s 420", "deposit", "footage", "ipc")
_JSONS = ('{"statement_id": "s", "transactions": []}', '{"document": {"document_type": "Bank_Statement"}}', '{"account": {}}', '{"STATEMENT_ID": 1, "bank": 2}', '{"statement_id": "", "transactions": [1]}', "not json", "")


def _uploads(s: str) -> str:
    header = " || ',' || ".join(f"({_pick(_CELLS, f'u * {a} + k * {b} + {c}')})" for a, b, c in ((1, 0, 0), (3, 1, 5), (0, 7, 2), (5, 2, 11)))
    text = " || ' ' || ".join(f"({_pick(_PHRASES, f'u * {a} + k * {b} + {c}')})" for a, b, c in ((2, 1, 0), (1, 5, 3), (7, 3, 8)))
    return f"""SELECT event_id, ({_pick(_NAMES, "k * 5 + u")}) || CASE WHEN k % 10 = 9 THEN ' ' || CAST(u AS {s}) ELSE '' END || '.' || ({_pick(_ENDINGS, "k + u * 3")}) AS name,
 CASE WHEN k % 11 = 0 THEN '' ELSE {header} END AS header, CASE WHEN (k + u * 3) % {len(_ENDINGS)} = 4 THEN {_pick(_JSONS, "u + k")} WHEN k % 13 = 0 THEN ' ' ELSE {text} END AS text,
 k % 17 = 0 AS filed, k % 19 = 0 AS known"""


def _kinds(spark, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CAST(user_id AS INT) AS u", "CAST(event_id % 9973 AS INT) AS k")
    files = spark.sql(_uploads("STRING").replace("{", "{{").replace("}", "}}") + " FROM {ev}", ev=ev)
    found = files.join(C.documents(files, "event_id").select("event_id", F.col("category").alias("keyword"), F.col("confidence").alias("sure")), "event_id")
    c = F.col
    out = C.upload_kind(c("name"), c("header"), c("text"), c("keyword"), c("sure"), c("filed"), c("known"))
    return found.select("event_id", "name", C.filename_kind(c("name")).alias("hint"), C.header_kind(c("header")).alias("said"), "keyword", out.alias("r")).select("event_id", "name", "hint", "said", "keyword", "r.*", C.ingest_kind(c("r.category")).alias("kind"))


def _kinds_sql() -> str:
    sums = ", ".join("(" + " + ".join(f"CASE WHEN contains(t, {_sql(p.strip())}) THEN {w} ELSE 0 END" for p, w in rules) + f") AS {k}" for k, rules in C.KEYWORDS.items())
    signs = " + ".join(f"regexp_matches(h, {_sql(p)})::INT" for p in C.EXPORT_SIGNS)
    ingest = " ".join(f"WHEN {_sql(k)} THEN {_sql(v)}" for k, v in C.INGEST_KIND.items())
    tables, texts = (", ".join(map(_sql, x)) for x in (C.TABLE_ENDINGS, C.TEXT_ENDINGS))
    return f"""WITH f AS ({_uploads("VARCHAR")} FROM (SELECT event_id, user_id::INT AS u, (event_id % 9973)::INT AS k FROM events)),
 n AS (SELECT *, regexp_replace(regexp_replace(lower(name), '^fir-[0-9]{{4}}-[0-9]+[_-]', ''), '^[0-9]{{8}}_[0-9]{{6}}_', '') AS low, lower(string_split(name, '.')[-1]) AS ending, lower(header) AS h, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM f),
 m AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(low, '\\.[^.]*$', ''), '(^|[^0-9])[6-9][0-9]{{9}}\\s*$') THEN 'cdr' WHEN contains(low, 'unified_master_cdr') OR regexp_matches(low, '(^|[^a-z])cdr([^a-z]|$)') THEN 'cdr'
  WHEN contains(low, 'unified_master_ipdr') OR regexp_matches(low, '(^|[^a-z])ipdr([^a-z]|$)') THEN 'ipdr' WHEN low LIKE 'accounts%' OR contains(low, 'accounts.csv') THEN 'accounts' WHEN low LIKE 'transactions%' OR contains(low, 'transactions.csv') THEN 'transactions'
  WHEN regexp_matches(low, 'statement|icore|bank|ledger|(^|[^a-z])stmt([^a-z]|$)|[0-9]{{12,18}}') THEN 'bank' WHEN regexp_matches(low, '(^|[^a-z0-9])fir([^a-z0-9-]|$)|first information') THEN 'fir' END AS hint,
  {_RX(C.HEADERS["cdr"])} AS c, {_RX(C.HEADERS["ipdr"])} AS i, {_RX(C.HEADERS["bank"])} AS b, {sums}, {signs} AS signs FROM n),
 o AS (SELECT *, greatest(c, i, b) AS best, list_sort([c, i, b], 'DESC')[2] AS second, greatest(fir, kyc, cctv, bank) AS top, list_sort([fir, kyc, cctv, bank], 'DESC')[2] AS next FROM m),
 k AS (SELECT *, CASE WHEN best < 5 THEN 'quarantine' WHEN best - second < 2 AND second >= 5 THEN CASE WHEN c >= second THEN 'cdr' WHEN i >= second THEN 'ipdr' ELSE 'bank' END WHEN c = best THEN 'cdr' WHEN i = best THEN 'ipdr' ELSE 'bank' END AS said,
  CASE WHEN t = '' THEN 'quarantine' WHEN top < 4 OR (top - next < 2 AND next >= 4) THEN 'other' WHEN fir = top THEN 'fir' WHEN kyc = top THEN 'kyc' WHEN cctv = top THEN 'cctv' ELSE 'bank' END AS keyword,
  CASE WHEN t = '' OR top < 4 THEN 0e0 WHEN top - next < 2 AND next >= 4 THEN 2e-1 ELSE least(1e0, top / 16e0) END AS sure,
  text IN ({", ".join(_sql(_JSONS[i]) for i in (0, 1, 3, 4))}) AS schema, ending IN ({tables}) AS tab, ending IN ({texts}) AS txt FROM o),
 r AS (SELECT *, CASE WHEN tab THEN CASE WHEN said IN ('cdr', 'ipdr') THEN {{'g': said, 'p': 92e-2}} WHEN said = 'bank' AND hint IN ('accounts', 'transactions') THEN {{'g': hint, 'p': 9e-1}} WHEN said = 'bank' THEN {{'g': said, 'p': 88e-2}}
   WHEN signs >= 3 THEN {{'g': 'bank', 'p': 9e-1}} WHEN hint IN ('cdr', 'ipdr', 'bank', 'accounts', 'transactions') THEN {{'g': hint, 'p': 65e-2}} ELSE {{'g': 'quarantine', 'p': 0e0}} END
  WHEN hint IN ('cdr', 'ipdr') THEN {{'g': hint, 'p': 8e-1}} WHEN filed THEN {{'g': 'bank', 'p': 95e-2}} WHEN known AND ending IN ('pdf', 'json') THEN {{'g': 'bank', 'p': 92e-2}}
  WHEN ending = 'json' THEN CASE WHEN schema THEN {{'g': 'bank', 'p': 95e-2}} ELSE {{'g': 'other', 'p': 4e-1}} END
  WHEN txt THEN CASE WHEN keyword IN ('quarantine', 'fir', 'other') AND hint = 'bank' THEN {{'g': 'bank', 'p': 65e-2}} WHEN keyword = 'quarantine' AND hint IS NOT NULL THEN {{'g': hint, 'p': 5e-1}} ELSE {{'g': keyword, 'p': sure}} END
  WHEN hint IS NOT NULL THEN {{'g': hint, 'p': 45e-2}} ELSE {{'g': 'other', 'p': 3e-1}} END AS r FROM k)
 SELECT event_id, name, hint, said, keyword, r.g AS category, r.p::DOUBLE AS confidence, CASE r.g {ingest} ELSE 'DOCUMENT' END AS kind FROM r"""


QUERIES["upload_kinds"] = _kinds
ORACLE_SQL["upload_kinds"] = _kinds_sql()

# --- rows of files ---

_ROW_CELLS = ("Call Date", "a_party", "12.50", "IP", "Narration :", "", "Remark", "1,000", "MSISDN", "Balance", "x", "F  Date", "t time.", "7", "UPI debit", "Mobile", "Start Time", "VALUE", "Report", "ip address")
_ROWS, _WIDTH = 6, 4


def _grid(spark, sf_dir: str) -> DataFrame:
    """A file of six rows of four cells for each event."""
    cells = F.array(*map(F.lit, _ROW_CELLS))
    at = lambda r, j: F.get(cells, ((F.col("k") * (j + 1) + F.col("u") * (r + 2) + F.lit(r * r * 7 + j * 3)) % len(_ROW_CELLS)).cast("int"))
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("CAST(event_id AS STRING) || CASE WHEN event_id % 31 = 0 THEN ' Summary.xlsx' ELSE '.csv' END AS path", "CAST(user_id AS INT) AS u", "CAST(event_id % 9973 AS INT) AS k")
    rows = F.array(*[F.array(*[at(r, j) for j in range(_WIDTH)]) for r in range(_ROWS)])
    return ev.select("path", F.posexplode(rows).alias("line_no", "cells"))


_GRID = f"""WITH g AS (SELECT event_id::VARCHAR || CASE WHEN event_id % 31 = 0 THEN ' Summary.xlsx' ELSE '.csv' END AS path, r.r, j.j, (k * (j + 1) + u * (r + 2) + r * r * 7 + j * 3) % {len(_ROW_CELLS)} AS c FROM (SELECT event_id, user_id AS u, event_id % 9973 AS k FROM events), range({_ROWS}) AS r(r), range({_WIDTH}) AS j(j)),
 v AS (SELECT path, r, cell FROM g JOIN (VALUES {", ".join(f"({i}, {_sql(c)})" for i, c in enumerate(_ROW_CELLS))}) AS t(c, cell) USING (c))"""
QUERIES["header_rows"] = lambda spark, sf_dir: C.header_row(_grid(spark, sf_dir))
ORACLE_SQL["header_rows"] = (
    _GRID
    + f""", w AS (SELECT path, r, trim(regexp_replace(replace(lower(trim(cell)), '_', ' '), '\\s+', ' ', 'g'), ' :.-') AS w FROM v),
 s AS (SELECT path, r, count(*) AS n, count(*) FILTER (regexp_full_match(replace(w, ' ', ''), '[0-9.,]+')) AS digits, sum({" + ".join(f"contains(w, {_sql(x)})::INT" for x in C.CUE_WORDS)})::INT AS score FROM w WHERE w <> '' GROUP BY 1, 2)
 SELECT path, arg_min(r, -100 * score + r)::INT AS line_no, max(score) AS score FROM s WHERE n >= 2 AND digits / n <= 0.5 GROUP BY 1"""
)
QUERIES["session_header_rows"] = lambda spark, sf_dir: S.best_header(_grid(spark, sf_dir))
ORACLE_SQL["session_header_rows"] = (
    _GRID
    + f""", s AS (SELECT path, r, count(*) FILTER (trim(regexp_replace(trim(lower(cell)), '\\s+', ' ', 'g'), ' :.-') IN ({", ".join(_sql(h) for h in S.SESSION_HEADERS)}))::INT AS hits FROM v WHERE NOT contains(lower(path), 'summary') GROUP BY 1, 2)
 SELECT path, arg_min(r, -100 * hits + r)::INT AS line_no, max(hits) AS hits FROM s WHERE hits >= 2 GROUP BY 1"""
)

# --- what a document is loaded as when it is loaded again ---

_FILED = ("bank_statement", "BANK", "cdr", "ipdr", "accounts", "other", "", "Transactions", "fir")
_SNIFFED = ("cdr", "ipdr", "bank", "quarantine", "CDR")
_AGAIN = f"""SELECT event_id, {{0}} AS kind, {_pick(_FILED, "u * 3 + k")} AS detected, {_pick(_SNIFFED, "u + k * 2")} AS sniffed, ({_pick(_NAMES, "k * 5 + u")}) || '.' || ({_pick(_ENDINGS, "k + u * 3")}) AS name"""
_AGAIN = _AGAIN.replace("{0}", _pick(_FILED, "k"))


def _resniffed(spark, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CAST(user_id AS INT) AS u", "CAST(event_id % 9973 AS INT) AS k")
    rows = spark.sql(_AGAIN + " FROM {ev}", ev=ev)
    return rows.select("event_id", "name", C.resniffed(F.col("kind"), F.col("detected"), F.col("sniffed"), F.col("name")).alias("load_as"))


_LOAD = "CASE lower({0}) WHEN 'bank_statement' THEN 'bank_statement' WHEN 'bank' THEN 'bank_statement' WHEN 'accounts' THEN 'bank_statement' WHEN 'transactions' THEN 'bank_statement' WHEN 'cdr' THEN 'cdr' WHEN 'ipdr' THEN 'ipdr' END"
QUERIES["resniff_signs"] = _resniffed
ORACLE_SQL["resniff_signs"] = f"""WITH a AS ({_AGAIN} FROM (SELECT event_id, user_id::INT AS u, (event_id % 9973)::INT AS k FROM events)),
 b AS (SELECT *, coalesce({_LOAD.format("kind")}, {_LOAD.format("detected")}) AS filed, lower(name) AS n, CASE WHEN regexp_matches(lower(name), '\\.(csv|tsv|xlsx|xls|xlsm)$') THEN lower(sniffed) END AS said FROM a)
 SELECT event_id, name, CASE WHEN regexp_matches(' ' || regexp_replace(n, '\\.[^.]*$', '') || ' ', '[^0-9][6-9][0-9]{{9}}[^0-9]') THEN 'cdr' WHEN said IN ('cdr', 'ipdr') THEN said WHEN said = 'bank' AND coalesce(filed, '') NOT IN ('cdr', 'ipdr') THEN 'bank_statement'
  WHEN filed IS NOT NULL THEN filed WHEN regexp_matches(n, '\\.(xlsx|xls|xlsm|csv|pdf)$') AND regexp_matches(n, 'stmt|statement|icore|bank|ledger|account') THEN 'bank_statement' END AS load_as FROM b"""
