"""Queries of cases and summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import casework as W
from ..operators import patterns as P
from ..sources.views import DUCK, evidence
from . import core, risk, story

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name, plan, sql, head: bool = True) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(evidence(spark, sf_dir))
    ORACLE_SQL[name] = (DUCK + (", " if sql.lstrip().startswith("+") else " ") + sql.lstrip().removeprefix("+")) if head else sql


def _cases(ev):
    return ev.cases.select("case_id", F.when(F.col("case_id") == "CASE-B", "active").otherwise("closed").alias("status"))


query("active_case", lambda ev: W.active_case(_cases(ev)), "SELECT 'CASE-B' AS case_id, 'active' AS status FROM cases GROUP BY 1, 2 HAVING bool_or(case_id = 'CASE-B')")
query("seed_set", lambda ev: W.seed_set(ev.ent).select("entity_id", "is_seed"), "SELECT entity_id, is_seed FROM ent WHERE is_seed")
query("seed_set_fallback", lambda ev: W.seed_set(ev.ent.where("not is_seed")).select("entity_id", "is_seed"), "SELECT entity_id, is_seed FROM ent WHERE NOT is_seed ORDER BY entity_id LIMIT 10")
query("phone_map", lambda ev: W.phone_map(ev.ent), "SELECT phone, entity_id, entity_name, is_seed FROM ent")
query("timeline_counts", lambda ev: W.timeline_counts(ev, 50), f"SELECT entity_id, count(*) FILTER (source = 'BANK') AS bank, count(*) FILTER (source = 'CDR') AS cdr, count(*) FILTER (source = 'IPDR') AS ipdr, count(*) AS total FROM ({story.ORACLE_SQL['entity_timeline']}) GROUP BY 1", False)
_COUNTS = {"rapid_layering": core, "convergence_48h": core, "call_before_transfer": core, "graph_nodes": story, "graph_edges": story}
_TABLES = {"entities": "ent", "transactions": "tx", "telecom": "tel"}
query(
    "stack_summary",
    W.stack_summary,
    " UNION ALL ".join([f"SELECT '{n}' AS name, count(*) AS n FROM ({m.ORACLE_SQL[n]}) z" for n, m in _COUNTS.items()] + [f"SELECT '{n}' AS name, count(*) AS n FROM ({DUCK} SELECT * FROM {t}) z" for n, t in _TABLES.items()]),
    False,
)
query(
    "command_centre",
    lambda ev: W.command_centre(ev).drop("money_shown"),
    f"SELECT o.entities, o.transactions, o.cdr, o.ipdr, o.credit_total AS money_traced, o.seeds, (SELECT count(*) FROM (SELECT * FROM ({risk.ORACLE_SQL['risk_leaderboard']}) ORDER BY total DESC, confidence DESC, inflow DESC, entity_id LIMIT 50) b WHERE category IN ('CRITICAL', 'HIGH')) AS priority_leads, (o.transactions + o.cdr + o.ipdr)::BIGINT AS total_events FROM ({core.ORACLE_SQL['overview_stats']}) o",
    False,
)
query(
    "flagged_records",
    lambda ev: W.flagged_hubs(P.convergence(ev.tx, ev.acc)).unionByName(W.flagged_calls(P.call_before_transfer(ev))),
    f"SELECT dest AS id, 'Hub: ' || dest AS title, sources || ' sources | ' || transfers || ' tx | ₹' || printf('%.2f', amount) AS detail FROM ({core.ORACLE_SQL['convergence_48h']}) c UNION ALL SELECT transaction_id, 'Call → Transfer: ' || transaction_id, calls || ' matching calls | Amount ₹' || printf('%.2f', amount) FROM ({core.ORACLE_SQL['call_before_transfer']}) d",
    False,
)


def _case_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "CASE-A").otherwise("CASE-B").alias("case_id"), (F.col("doc_id") % 97).alias("uploaded_at"))
    return W.case_documents(docs, _cases(evidence(spark, sf_dir)))


QUERIES["case_documents"] = _case_documents
ORACLE_SQL["case_documents"] = "SELECT doc_id, 'CASE-B' AS case_id, doc_id % 97 AS uploaded_at FROM documents WHERE doc_id % 2 <> 0 ORDER BY uploaded_at DESC, doc_id LIMIT 300"
