"""Queries of the risk score, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import scoring as S
from ..sources.views import DUCK, evidence
from .core import NORMS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

FEATURES = NORMS + """, es AS (SELECT entity_id, sum(tx_count)::BIGINT AS tx_count, sum(inflow) AS inflow, sum(outflow) AS outflow, sum(in_count)::BIGINT AS in_count, sum(out_count)::BIGINT AS out_count,
  len(list_distinct(flatten(list(in_parties))))::INT AS in_parties, len(list_distinct(flatten(list(out_parties))))::INT AS out_parties, min(first_at) AS first_at, max(last_at) AS last_at, sum(round_count)::BIGINT AS round_count FROM st JOIN acc USING (account_id) GROUP BY 1),
 ts AS (SELECT msisdn AS phone, count(*) FILTER (event_type = 'CDR') AS cdr, count(*) FILTER (event_type = 'IPDR') AS ipdr, min(event_at) AS tel_first, max(event_at) AS tel_last FROM tel WHERE msisdn <> '' GROUP BY 1),
 f0 AS (SELECT e.entity_id, e.entity_name, e.is_seed, coalesce(tx_count, 0) AS tx_count, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow, coalesce(in_count, 0) AS in_count, coalesce(out_count, 0) AS out_count,
  coalesce(in_parties, 0) AS in_parties, coalesce(out_parties, 0) AS out_parties, coalesce(round_count, 0) AS round_count, coalesce(cdr, 0) AS cdr, coalesce(ipdr, 0) AS ipdr, first_at, last_at, tel_first, tel_last,
  CASE WHEN first_at IS NOT NULL THEN greatest(1, date_diff('day', first_at::DATE, last_at::DATE) + 1) END AS span FROM ent e LEFT JOIN es USING (entity_id) LEFT JOIN ts USING (phone)),
 f1 AS (SELECT *, CASE WHEN inflow > 0 THEN outflow / inflow ELSE 0e0 END AS ratio, coalesce(tx_count / span, 0e0) AS per_day FROM f0),
 rk AS (SELECT f1.*, CASE WHEN inflow > 0 THEN (SELECT coalesce(sum(n), 0) FROM norm WHERE measure = 'inflow' AND value <= f1.inflow)::DOUBLE / (SELECT sum(n) FROM norm WHERE measure = 'inflow') ELSE 0e0 END AS inflow_rank,
  CASE WHEN outflow > 0 THEN (SELECT coalesce(sum(n), 0) FROM norm WHERE measure = 'outflow' AND value <= f1.outflow)::DOUBLE / (SELECT sum(n) FROM norm WHERE measure = 'outflow') ELSE 0e0 END AS outflow_rank,
  CASE WHEN per_day > 0 THEN (SELECT coalesce(sum(n), 0) FROM norm WHERE measure = 'per_day' AND value <= f1.per_day)::DOUBLE / (SELECT sum(n) FROM norm WHERE measure = 'per_day') ELSE 0e0 END AS per_day_rank FROM f1),
 f2 AS (SELECT *, tx_count >= 400 OR coalesce(span >= 45 AND tx_count >= 80, false) AS operating, (in_parties >= 3 AND out_parties <= 2) OR (out_parties >= 3 AND in_parties <= 2) AS fan,
  coalesce(first_at <= tel_last AND tel_first <= last_at, false) AS overlap FROM rk),
 f3 AS (SELECT *, (coalesce(span <= 21 AND tx_count >= 4, false)::INT + (tx_count BETWEEN 4 AND 150)::INT + fan::INT + (tx_count >= 6 AND round_count / greatest(tx_count, 1) >= 5e-1)::INT + (is_seed AND tx_count <= 200)::INT) AS flags FROM f2),
 f4 AS (SELECT *, flags >= 2 AS shape_ok, in_count >= 2 AND out_count >= 2 AND inflow >= 25000 AS paid, 1e0 - least(1e0, abs(1e0 - ratio) / 4e-1) AS tight FROM f3),
 f5 AS (SELECT *, CASE WHEN in_count = 0 AND out_count = 0 THEN 'NO LEDGER' WHEN operating AND in_count >= 2 AND out_count >= 2 THEN 'OPERATING ACCOUNT' WHEN in_count = 0 THEN 'SOURCE (ORIGINATOR)' WHEN out_count = 0 THEN 'SINK (TERMINAL)'
  WHEN paid AND ratio BETWEEN 85e-2 AND 112e-2 AND shape_ok THEN 'INTERMEDIARY MULE' WHEN fan AND in_parties >= 4 AND out_parties <= 2 AND NOT operating THEN 'FUNNEL / COLLECTOR' WHEN fan AND out_parties >= 4 AND in_parties <= 2 AND NOT operating THEN 'DISTRIBUTOR'
  WHEN paid AND ratio >= 7e-1 AND shape_ok THEN 'LAYERED FORWARDER' ELSE 'STANDARD PARTICIPANT' END AS role,
  CASE WHEN NOT operating AND shape_ok AND paid AND ratio >= 6e-1 AND tight > 0 THEN round_even(24 * tight, 0)::INT ELSE 0 END AS pt,
  NOT operating AND tx_count BETWEEN 3 AND 200 AND inflow >= 25000 AS fans, NOT operating AND cdr >= 8 AND ipdr >= 3 AS pair,
  CASE WHEN greatest(inflow_rank, outflow_rank) < 62e-2 THEN 0 ELSE round_even(16e0 * (greatest(inflow_rank, outflow_rank) - 62e-2) / 38e-2, 0)::INT END AS vol0,
  CASE WHEN operating OR per_day = 0 OR per_day_rank < 7e-1 THEN 0 ELSE round_even(10e0 * (per_day_rank - 7e-1) / (1e0 - 7e-1), 0)::INT END AS vel FROM f4)"""
RANKS = FEATURES
POINTS = FEATURES + """, pts AS (SELECT entity_id, 1 AS o, 'Pass-through' AS evidence, 'behavior' AS bucket, CASE WHEN pt >= 6 THEN pt ELSE 0 END AS points FROM f5
 UNION ALL SELECT entity_id, 2, 'Rapid drain', 'behavior', CASE WHEN pt >= 10 AND span <= 3 AND tx_count >= 4 THEN 10 ELSE 0 END FROM f5
 UNION ALL SELECT entity_id, 3, 'Short-window layering', 'behavior', CASE WHEN pt >= 10 AND NOT (span <= 3 AND tx_count >= 4) AND span <= 7 AND tx_count >= 6 THEN 6 ELSE 0 END FROM f5
 UNION ALL SELECT entity_id, 4, 'Fan-in collector', 'behavior', CASE WHEN fans AND in_parties >= 5 AND out_parties <= 2 THEN 12 WHEN fans AND in_parties >= 3 AND out_parties <= 1 THEN 8 ELSE 0 END FROM f5
 UNION ALL SELECT entity_id, 5, 'Fan-out distributor', 'behavior', CASE WHEN fans AND ((in_parties >= 5 AND out_parties <= 2) OR (in_parties >= 3 AND out_parties <= 1)) THEN 0 WHEN fans AND out_parties >= 5 AND in_parties <= 2 THEN 10 ELSE 0 END FROM f5
 UNION ALL SELECT entity_id, 6, 'Terminal sink', 'behavior', CASE WHEN out_count = 0 AND in_count >= 3 AND inflow_rank >= 75e-2 THEN 8 ELSE 0 END FROM f5
 UNION ALL SELECT entity_id, 7, 'Originator', 'behavior', CASE WHEN in_count = 0 AND out_count >= 3 AND outflow_rank >= 75e-2 THEN 6 ELSE 0 END FROM f5
 UNION ALL SELECT entity_id, 8, 'Case-high volume', 'transactions', CASE WHEN operating THEN least(vol0, 6) WHEN NOT shape_ok THEN least(vol0, 8) ELSE vol0 END FROM f5
 UNION ALL SELECT entity_id, 9, 'High velocity', 'transactions', vel FROM f5
 UNION ALL SELECT entity_id, 10, 'Round-amount structuring', 'transactions', CASE WHEN NOT operating AND tx_count BETWEEN 6 AND 200 AND round_count / tx_count >= 55e-2 AND round_count >= 5 THEN CASE WHEN round_count / tx_count >= 75e-2 THEN 8 ELSE 5 END ELSE 0 END FROM f5
 UNION ALL SELECT entity_id, 11, 'CDR + IPDR both present', 'communication', CASE WHEN pair THEN CASE WHEN overlap THEN 7 ELSE 5 END ELSE 0 END FROM f5
 UNION ALL SELECT entity_id, 12, 'Telecom window overlaps ledger', 'communication', CASE WHEN pair AND overlap THEN 5 ELSE 0 END FROM f5
 UNION ALL SELECT entity_id, 13, 'Heavy IPDR', 'communication', CASE WHEN NOT operating AND NOT pair AND ipdr >= 8 THEN CASE WHEN overlap THEN 6 ELSE 4 END ELSE 0 END FROM f5
 UNION ALL SELECT entity_id, 14, 'Heavy CDR', 'communication', CASE WHEN NOT operating AND NOT pair AND ipdr < 8 AND overlap AND cdr >= 40 THEN 4 ELSE 0 END FROM f5),
 behaving AS (SELECT entity_id, sum(points) AS b FROM pts GROUP BY 1),
 every AS (SELECT * FROM pts WHERE points > 0 UNION ALL SELECT entity_id, 15, CASE WHEN b >= 12 THEN 'FIR-named party + independent indicators' ELSE 'FIR-named party' END, CASE WHEN b >= 12 OR tx_count >= 3 THEN 'case_link' ELSE 'identifiers' END,
  CASE WHEN b >= 12 THEN 8 WHEN tx_count >= 3 THEN 4 ELSE 3 END FROM f5 JOIN behaving USING (entity_id) WHERE is_seed)"""
BOARD = POINTS + """, sums AS (SELECT f5.entity_id, coalesce(sum(points), 0)::INT AS total, coalesce(sum(points) FILTER (bucket = 'case_link'), 0)::INT AS case_link_points, coalesce(sum(points) FILTER (bucket = 'transactions'), 0)::INT AS transactions_points,
  coalesce(sum(points) FILTER (bucket = 'behavior'), 0)::INT AS behavior_points, coalesce(sum(points) FILTER (bucket = 'communication'), 0)::INT AS communication_points, coalesce(sum(points) FILTER (bucket = 'identifiers'), 0)::INT AS identifiers_points FROM f5 LEFT JOIN every USING (entity_id) GROUP BY 1),
 board AS (SELECT entity_id, entity_name, is_seed, role, total, CASE WHEN ok AND total >= 58 AND behavior_points >= 16 AND tx_count BETWEEN 4 AND 250 AND confidence >= 62e-2 THEN 'CRITICAL' WHEN ok AND total >= 38 AND confidence >= 62e-2 THEN 'HIGH' WHEN total >= 28 THEN 'MEDIUM' ELSE 'LOW' END AS category,
  confidence, tx_count, inflow, outflow, round_even(ratio, 2) AS ratio, cdr, ipdr, case_link_points, transactions_points, behavior_points, communication_points, identifiers_points FROM (SELECT *,
  NOT operating AND shape_ok AND (pt >= 12 OR behavior_points >= 12) AS ok, CASE WHEN tx_count >= 20 THEN 95e-2 WHEN tx_count >= 8 THEN 8e-1 WHEN tx_count >= 3 THEN 62e-2 WHEN tx_count >= 1 THEN 35e-2 WHEN cdr > 0 OR ipdr > 0 OR is_seed THEN 15e-2 ELSE 5e-2 END AS confidence FROM f5 JOIN sums USING (entity_id)))"""


def query(name, plan, sql) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(evidence(spark, sf_dir))
    ORACLE_SQL[name] = DUCK + ", " + sql.lstrip().removeprefix("+")


def ranks(ev):
    return S.features(ev).select("entity_id", "inflow_rank", "outflow_rank", "per_day_rank")


def shapes(ev):
    return S.with_shape(S.features(ev)).select("entity_id", "operating", "fan", "flags", "shape_ok")


query("pct_rank", ranks, RANKS + " SELECT entity_id, inflow_rank, outflow_rank, per_day_rank FROM f5")
query("mule_shape", shapes, FEATURES + " SELECT entity_id, operating, fan, flags, shape_ok FROM f5")
query("account_role", lambda ev: S.with_shape(S.features(ev)).select("entity_id", "role", F.bround("ratio", 4).alias("ratio")), FEATURES + " SELECT entity_id, role, round_even(ratio, 4) AS ratio FROM f5")
query("risk_indicators", lambda ev: S.breakdown(S.profiles(ev)), POINTS + """ SELECT entity_id, (row_number() OVER (PARTITION BY entity_id ORDER BY o) - 1)::INT AS position, evidence, bucket, points::INT AS points FROM every
 UNION ALL SELECT entity_id, 0, 'Insufficient pattern evidence', 'none', 0 FROM f5 WHERE entity_id NOT IN (SELECT entity_id FROM every)""")
query("risk_leaderboard", lambda ev: S.leaderboard(S.profiles(ev)), BOARD + " SELECT * FROM board")
query("risk_top", lambda ev: S.leaderboard(S.profiles(ev), 50), BOARD + " SELECT * FROM board ORDER BY total DESC, confidence DESC, inflow DESC, entity_id LIMIT 50")
query("severity_counts", lambda ev: A.severity_counts(S.profiles(ev).withColumnRenamed("category", "severity")), BOARD + " SELECT category AS severity, count(*) AS n FROM board GROUP BY 1")
