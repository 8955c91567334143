"""Queries of texts within texts: account numbers in documents, holders in file names;
and their SQL, which compares every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..sources.views import DUCK, evidence

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name, plan, sql) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(evidence(spark, sf_dir))
    ORACLE_SQL[name] = DUCK + ", " + sql


# The same expressions in both dialects: numbers of one bank, which share a prefix, some
# short or with blanks in them, and what documents and their names say of them.
_NUMBER = """CASE WHEN u % 13 = 0 THEN lpad(CAST((u * 7919) % 100000 AS {S}), 5, '7') WHEN u % 17 = 0 THEN ''
 ELSE '501000' || lpad(CAST((u * 7919) % 1000003 AS {S}), 7, '0') END"""
_TEXT = """CASE u % 9 WHEN 0 THEN 'A/c No: ' || n || ' of a holder' WHEN 1 THEN 'account number - ' || n || ', Acct Range: ' || m WHEN 2 THEN 'paid from ' || n || ' on 20240131'
 WHEN 3 THEN 'x' || n || 'y' WHEN 4 THEN '00000' || n || ' ' || substr(m, 3) WHEN 5 THEN 'Account No.' || substr(n, 1, 9) WHEN 6 THEN '' WHEN 7 THEN 'ref 501000000 and ' || n || n ELSE 'no number' END"""
_FILE = "CASE u % 4 WHEN 0 THEN substr(n, 9) || '.pdf' WHEN 1 THEN 'st_' || m || '.x.pdf' WHEN 2 THEN 'scan.pdf' ELSE ' ' || substr(m, 6) || '.csv' END"
_DOCS = f"SELECT u, 'f' || CAST(u AS {{S}}) AS doc, {_TEXT} AS text, {_FILE} AS name FROM (SELECT u, number AS n, lag(number, 1, '501000777') OVER (PARTITION BY u % 29 ORDER BY u) AS m FROM {{numbers}})"
_NUMBERS = f"SELECT u, entity_id AS account_id, {_NUMBER} AS number FROM {{ent}}"


def _accounts(ev) -> DataFrame:
    spark = ev.ent.sparkSession
    numbers = spark.sql(_NUMBERS.format(S="STRING", ent="{ent}"), ent=ev.ent)
    docs = spark.sql(_DOCS.format(S="STRING", numbers="{numbers}"), numbers=numbers)
    return I.account_matches(docs, numbers.select("account_id", F.concat_ws(" ", F.left("number", F.lit(6)), F.substring("number", 7, 20)).alias("account_number")))


_LABEL = I.ACCOUNT_LABEL.replace("'", "''")
query(
    "account_matches",
    _accounts,
    f"""nums AS MATERIALIZED ({_NUMBERS.format(S="VARCHAR", ent="ent")}), docs AS ({_DOCS.format(S="VARCHAR", numbers="nums")}),
 stems AS (SELECT *, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem FROM docs),
 runs AS (SELECT doc, unnest(regexp_extract_all(text, '{_LABEL}', 1)) AS run FROM docs UNION SELECT doc, unnest(regexp_extract_all(text, '\\b(\\d{{9,18}})\\b', 1)) FROM docs
  UNION SELECT doc, unnest(regexp_extract_all(stem, '\\d{{9,18}}')) FROM stems UNION SELECT doc, trim(stem) FROM stems WHERE regexp_full_match(trim(stem), '\\d{{5,8}}'))
 SELECT DISTINCT doc, account_id FROM runs JOIN nums ON length(number) >= 5 AND (contains(number, run) AND length(run) >= 5 OR length(run) >= 5 AND ends_with(run, right(number, 12)))""",
)

_WORDS = ("kumar", "sharma", "patel", "singh", "mehta", "iyer", "nair", "rao", "banerjee", "chatterjee", "joshi", "kulkarni", "deshpande", "ann", "lata", "madhu")
# common words for many, rare ones for few
_NAME = """concat_ws(' ', entity_name, CASE WHEN u % 3 = 0 THEN 'Kumar' ELSE '' END, {w}[1 + u % 16], CASE WHEN u % 50 = 7 THEN 'Vishwanath' || CAST(u AS {S}) ELSE '' END, {w}[1 + (u * u) % 16])"""
_NAMED = """concat_ws('-', 'Statement', {w}[1 + (u * 5) % 16], CASE WHEN u % 2 = 0 THEN 'KUMAR' ELSE 'x' END, CASE WHEN u % 5 = 0 THEN 'vishwanath' ELSE '' END, {w}[1 + (u * u) % 16],
 CASE WHEN u % 7 = 0 THEN 'holder' ELSE 'nov' END, CASE WHEN u % 11 = 0 THEN 'nobodyhasit' ELSE CAST(u AS {S}) END) || '.pdf'"""


def _names(ev) -> DataFrame:
    spark = ev.ent.sparkSession
    words = "array(" + ", ".join(f"'{w}'" for w in _WORDS) + ")"
    at = lambda text: text.replace("{w}[", "element_at({w}, CAST(").replace("% 16]", "% 16 AS INT))").format(w=words, S="STRING")
    made = spark.sql(f"SELECT entity_id, u, {at(_NAME)} AS full_name, {at(_NAMED)} AS name FROM {{ent}}", ent=ev.ent)
    found = I.name_matches(made.select(F.col("entity_id").alias("doc"), F.when(F.col("u") % 23 != 0, F.col("name")).otherwise("scan.pdf").alias("name")), made.select("entity_id", F.col("full_name").alias("entity_name")))
    return found


def _names_sql() -> str:
    words = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"
    name, named = _NAME.format(w=words, S="VARCHAR"), _NAMED.format(w=words, S="VARCHAR")
    stop = ", ".join(f"'{w}'" for w in I.NAME_STOP)
    return f"""made AS (SELECT entity_id, lower(concat_ws(' ', entity_id, {name})) AS text, CASE WHEN u % 23 <> 0 THEN {named} ELSE 'scan.pdf' END AS name FROM ent),
 toks AS (SELECT DISTINCT doc, w FROM (SELECT entity_id AS doc, unnest(regexp_split_to_array(lower(name), '[^a-z]+')) AS w FROM made) WHERE length(w) >= 4 AND w NOT IN ({stop})),
 hits AS (SELECT doc, entity_id, count(*) AS hits FROM toks JOIN made ON contains(text, w) GROUP BY 1, 2)
 SELECT doc, entity_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY hits DESC, entity_id DESC) AS nth FROM hits) WHERE nth = 1"""


query("name_matches", _names, _names_sql())
