"""Queries of time, graph and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import reports as R
from ..operators import timeline as T
from ..sources.views import DUCK, evidence
from .core import CORR, DEST, HUBS, OWNED, SAID_CLOCK
from .risk import BOARD

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name, plan, sql) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(evidence(spark, sf_dir))
    ORACLE_SQL[name] = DUCK + ", " + sql.lstrip().removeprefix("+")


SAID = f"said AS (SELECT *, {SAID_CLOCK} AS said, transaction_date::TIME <> TIME '00:00:00' AS clock FROM own)"
TIMES = OWNED + ", " + SAID + """, days AS (SELECT e.entity_id, t.event_at::DATE AS day, (list_sort(list(t.event_at)))[count(*) // 2 + 1] AS mid, bool_or(event_type = 'CDR') AS has_cdr FROM tel t JOIN ent e ON t.msisdn = e.phone WHERE t.event_at::TIME <> TIME '00:00:00' GROUP BY 1, 2),
 times AS (SELECT s.*, CASE WHEN clock THEN transaction_date ELSE coalesce(said, mid, transaction_date) END AS resolved_at, CASE WHEN clock THEN 'statement' WHEN said IS NOT NULL THEN 'narration' WHEN mid IS NOT NULL THEN CASE WHEN has_cdr THEN 'linked_cdr' ELSE 'linked_ipdr' END ELSE 'date_only' END AS time_source
 FROM said s LEFT JOIN days d ON s.entity_id = d.entity_id AND s.transaction_date::DATE = d.day)"""
query("clock_from_text", lambda ev: T.resolved(T.owned(ev.tx, ev.acc)).where("time_source = 'narration'").select("transaction_id", "resolved_at"), OWNED + ", " + SAID + " SELECT transaction_id, said AS resolved_at FROM said WHERE NOT clock AND said IS NOT NULL")
query("resolve_tx_time", lambda ev: T.tx_times(ev).select("transaction_id", "resolved_at", "time_source"), TIMES + " SELECT transaction_id, resolved_at, time_source FROM times")
query("entity_timeline", lambda ev: T.entity_timeline(ev, 50), TIMES + """, line AS (SELECT entity_id, 'BANK' AS source, resolved_at AS at_time, time_source, transaction_id AS ref, direction || ' ₹' || amount::VARCHAR AS title, coalesce(nullif(trim(counterparty_name), ''), narration) AS detail FROM times UNION ALL
 SELECT e.entity_id, event_type, event_at, 'clock', event_id, CASE WHEN event_type = 'IPDR' THEN 'IPDR ' || coalesce(nullif(ip_address, ''), 'session') ELSE 'CDR → ' || coalesce(nullif(b_party, ''), '—') END,
 CASE WHEN event_type = 'IPDR' THEN 'internet session' ELSE call_type || ' ' || duration_sec || 's' END FROM tel t JOIN ent e ON t.msisdn = e.phone)
 SELECT *, (row_number() OVER (PARTITION BY entity_id ORDER BY at_time DESC, ref DESC))::INT AS rank, strftime(at_time, '%d-%b-%Y %H:%M:%S') AS shown FROM line QUALIFY rank <= 50""")
query("activity_heatmap", T.heatmap, OWNED + ", " + SAID + """, acts AS (SELECT e.entity_id, extract(hour FROM event_at) AS hour FROM tel t JOIN ent e ON t.msisdn = e.phone WHERE event_at::TIME <> TIME '00:00:00' UNION ALL
 SELECT entity_id, extract(hour FROM CASE WHEN clock THEN transaction_date ELSE said END) FROM said WHERE clock OR said IS NOT NULL), n AS (SELECT entity_id, hour, count(*) AS n FROM acts GROUP BY 1, 2),
 grid AS (SELECT entity_id, h::INT AS hour FROM ent, range(24) r(h)), g AS (SELECT grid.entity_id, grid.hour, coalesce(n, 0) AS n FROM grid LEFT JOIN n ON grid.entity_id = n.entity_id AND grid.hour = n.hour)
 SELECT *, least(100, n * 15) AS val, CASE WHEN n >= 5 OR n * 15 > 75 THEN 'CRITICAL' WHEN n >= 2 OR n * 15 > 45 THEN 'HIGH' ELSE 'NORMAL' END AS status FROM g""")
BURSTS = """bd AS (SELECT transaction_date::DATE AS day, count(*) AS transfers, sum(amount)::DOUBLE AS total, array_to_string(list_sort(list(DISTINCT account_id))[1:6], ',') AS accounts FROM own WHERE is_seed GROUP BY 1 HAVING count(*) >= 3 AND sum(amount) >= 100000),
 bursts AS (SELECT *, least(95, 40 + least(30, transfers) + CASE WHEN total > 500000 THEN 20 ELSE 10 END)::BIGINT AS score FROM bd)"""
query("daily_bursts", T.daily_bursts, OWNED + ", " + BURSTS + " SELECT * FROM bursts")
EPISODES = CORR + ", " + BURSTS + """, net AS (SELECT event_at AS session_at FROM tel WHERE event_type = 'IPDR'),
 near AS (SELECT DISTINCT c.event_id FROM corr c JOIN net n ON n.session_at BETWEEN c.call_at - INTERVAL 6 HOURS AND c.call_at + INTERVAL 6 HOURS),
 ep AS (SELECT c.event_id AS key, 1 AS calls, CASE WHEN n.event_id IS NULL THEN 0 ELSE 1 END AS sessions, 1::BIGINT AS transfers, amount AS total, least(98, floor(score) + CASE WHEN n.event_id IS NULL THEN 0 ELSE 8 END)::BIGINT AS score,
 (CASE WHEN (660 - least(600, delta_sec)) % 6 < 3 OR ((660 - least(600, delta_sec)) % 6 = 3 AND ((660 - least(600, delta_sec)) // 6) % 2 = 0) THEN (660 - least(600, delta_sec)) // 6 ELSE (660 - least(600, delta_sec)) // 6 + 1 END) / 10 AS density FROM corr c LEFT JOIN near n USING (event_id) UNION ALL SELECT 'DAY-' || day, 0, 0, transfers, total, score, round_even(transfers / 24, 1) FROM bursts),
 kinds AS (SELECT *, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 OR calls = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN calls + sessions > 0 THEN 'Multi-Modal Pass-Through' ELSE 'High-Value Transfer Burst' END AS kind FROM ep)"""
query("episodes", T.episodes, EPISODES + " SELECT * FROM kinds")
query("top_episodes", lambda ev: T.episodes(ev, 15), EPISODES + ", top AS (SELECT * FROM kinds ORDER BY score DESC, key LIMIT 15) SELECT *, format('EPISODE-{:02d}', row_number() OVER (ORDER BY score DESC, key)) AS episode_id FROM top")

LINKS = OWNED + f""", ml AS (SELECT entity_id, account_id, {DEST} AS dest, count(*) AS n, sum(amount)::DOUBLE AS total FROM own WHERE {DEST} IS NOT NULL GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY sum(amount) DESC, account_id, dest) <= 25),
 cl AS (SELECT e.entity_id, t.msisdn, t.b_party, count(*) AS calls FROM tel t JOIN ent e ON t.msisdn = e.phone WHERE event_type = 'CDR' AND b_party NOT IN ('', '-') GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY e.entity_id ORDER BY count(*) DESC, t.b_party) <= 20),
 il AS (SELECT e.entity_id, t.msisdn, t.ip_address, count(*) AS sessions FROM tel t JOIN ent e ON t.msisdn = e.phone WHERE event_type = 'IPDR' AND ip_address <> '' GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY e.entity_id ORDER BY count(*) DESC, t.ip_address) <= 15),
 nodes AS (SELECT entity_id, entity_id AS id, 'entity' AS type FROM ent UNION SELECT entity_id, 'acc:' || account_id, 'account' FROM acc UNION SELECT entity_id, 'tel:' || phone, 'phone' FROM ent UNION SELECT entity_id, 'cp:' || dest, 'counterparty_account' FROM ml
 UNION SELECT entity_id, 'tel:' || b_party, 'phone' FROM cl UNION SELECT entity_id, 'ip:' || ip_address, 'ip' FROM il)"""
query("graph_nodes", G.nodes, LINKS + " SELECT * FROM nodes")
query("graph_edges", G.edges, LINKS + """ SELECT entity_id, entity_id AS source, 'acc:' || account_id AS target, 'ownership' AS type, 'owns' AS label FROM acc UNION ALL SELECT entity_id, entity_id, 'tel:' || phone, 'ownership', 'uses' FROM ent UNION ALL
 SELECT entity_id, 'acc:' || account_id, 'cp:' || dest, 'transaction', n || ' tx' FROM ml UNION ALL SELECT entity_id, 'tel:' || msisdn, 'tel:' || b_party, 'call', calls || ' calls' FROM cl UNION ALL SELECT entity_id, 'tel:' || msisdn, 'ip:' || ip_address, 'ipdr', sessions || ' sessions' FROM il""")
query("graph_summary", G.summary, LINKS + " SELECT entity_id, type, count(*) AS n FROM nodes GROUP BY 1, 2")
query("graph_tints", G.tints, LINKS + """, m AS (SELECT entity_id, count(*) AS tx, count(DISTINCT dest) AS cps FROM (SELECT entity_id, """ + DEST + """ AS dest FROM own) GROUP BY 1), c AS (SELECT entity_id, count(*) AS calls FROM (SELECT DISTINCT e.entity_id, t.msisdn, t.b_party FROM tel t JOIN ent e ON t.msisdn = e.phone WHERE t.event_type = 'CDR' AND t.b_party NOT IN ('', '-')) GROUP BY 1),
 f AS (SELECT entity_id, is_seed, coalesce(tx, 0) AS tx, coalesce(cps, 0) AS cps, coalesce(calls, 0) AS calls FROM ent LEFT JOIN m USING (entity_id) LEFT JOIN c USING (entity_id)),
 s AS (SELECT *, CASE WHEN tx >= 3 THEN least(40e0, (tx - 2) * 15e-1) ELSE 0 END + CASE WHEN cps >= 3 THEN least(30e0, (cps - 2) * 4e0) ELSE 0 END + CASE WHEN calls >= 8 THEN least(18e0, calls * 4e-1) ELSE 0 END AS s FROM f)
 SELECT entity_id, tx, cps, calls, round_even(least(100e0, s + CASE WHEN NOT is_seed THEN 0 WHEN s >= 12 THEN 8 ELSE 3 END), 1) AS tint FROM s""")
query("graph_highlights", G.highlights, LINKS + """, h AS (SELECT entity_id, dest AS id, round_even(least(40e0, sum(total) / 50000), 4) AS weight FROM ml GROUP BY 1, 2 UNION ALL SELECT entity_id, b_party, least(30e0, calls * 2e0) FROM cl UNION ALL SELECT entity_id, ip_address, least(20e0, sessions * 1e0) FROM il)
 SELECT *, (row_number() OVER (PARTITION BY entity_id ORDER BY weight DESC, id))::INT AS rank FROM h QUALIFY rank <= 12""")
# the risk tables and the call tables stand side by side
BOTH = BOARD + CORR.replace("+own AS", ", own AS", 1)
query("findings", R.findings, BOTH + f""", legs AS (SELECT * FROM own WHERE is_seed), debit AS ({HUBS} FROM legs WHERE direction = 'DR' GROUP BY 1 HAVING dest IS NOT NULL AND sources >= 2), every_leg AS ({HUBS} FROM legs GROUP BY 1 HAVING dest IS NOT NULL AND sources >= 2),
 conv AS (SELECT * FROM debit UNION ALL SELECT * FROM every_leg WHERE NOT EXISTS (SELECT 1 FROM debit)), mules AS (SELECT * FROM board WHERE role = 'INTERMEDIARY MULE' AND category IN ('HIGH', 'CRITICAL') AND inflow >= 50000 AND tx_count BETWEEN 3 AND 250 ORDER BY total DESC, confidence DESC, inflow DESC, entity_id LIMIT 4)
 SELECT * FROM (SELECT 'Multi-Seed Convergence' AS pattern, 'CRITICAL' AS severity, 95::BIGINT AS confidence, amount, dest AS subject FROM conv ORDER BY sources DESC, amount DESC, dest LIMIT 1) UNION ALL
 SELECT 'Rapid Pass-Through Layering', 'CRITICAL', 92, sum(inflow), string_agg(entity_id, ',' ORDER BY entity_id) FROM mules HAVING count(*) > 0 UNION ALL
 SELECT 'Cross-Dataset Coincidence', CASE WHEN count(*) >= 3 THEN 'CRITICAL' ELSE 'HIGH' END, least(98, 70 + count(*)), sum(amount::DECIMAL(18,2))::DOUBLE, count(*) || ' coincidences' FROM corr HAVING count(*) > 0 UNION ALL
 SELECT * FROM (SELECT 'Gather-Scatter Hub', 'HIGH', 85, amount, dest FROM ({HUBS} FROM tx GROUP BY 1 HAVING dest IS NOT NULL AND sources >= 3) ORDER BY amount DESC, dest LIMIT 1) UNION ALL
 SELECT * FROM (SELECT 'Smurfing / Structuring', 'HIGH', 87, sum(amount)::DOUBLE AS t, account_id FROM tx WHERE amount >= 40000 AND amount < 50000 GROUP BY account_id HAVING count(*) >= 3 ORDER BY count(*) DESC, t DESC, account_id LIMIT 1) UNION ALL
 SELECT 'IPDR Presence', 'MEDIUM', 75, 0, count(*) || ' sessions' FROM tel WHERE event_type = 'IPDR' HAVING count(*) > 0""")
query("str_report", R.str_report, BOTH + """, tops AS (SELECT entity_id, transaction_id, amount, row_number() OVER (PARTITION BY entity_id ORDER BY amount DESC, transaction_id) AS r FROM own QUALIFY r <= 15),
 t AS (SELECT entity_id, count(*) AS listed, sum(amount)::DOUBLE AS listed_amount, string_agg(transaction_id, ',' ORDER BY r) AS transfers FROM tops GROUP BY 1) SELECT entity_id, role, total, category, listed, listed_amount, transfers FROM board LEFT JOIN t USING (entity_id)""")
query("entity_dossier", R.dossier, OWNED + """, d AS (SELECT entity_id, sum(amount) FILTER (direction = 'CR')::DOUBLE AS credit, sum(amount) FILTER (direction = 'DR')::DOUBLE AS debit, count(*) AS transactions FROM own GROUP BY 1),
 t AS (SELECT e.entity_id, count(*) FILTER (event_type = 'CDR') AS cdr, count(*) FILTER (event_type = 'IPDR') AS ipdr FROM tel JOIN ent e ON msisdn = phone GROUP BY 1),
 c AS (SELECT entity_id, counterparty_name AS first_counterparty FROM own WHERE counterparty_name IS DISTINCT FROM '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, sum(amount) DESC, counterparty_name) = 1)
 SELECT e.entity_id, is_seed, credit, debit, transactions, nullif(cdr, 0) AS cdr, nullif(ipdr, 0) AS ipdr, first_counterparty FROM ent e LEFT JOIN d USING (entity_id) LEFT JOIN t USING (entity_id) LEFT JOIN c USING (entity_id)""")
query("preset_layering", lambda ev: R.preset(ev, "rapid_layering", ratio=0.95).select("transaction_id", F.bround("ratio", 6).alias("ratio"), "preset", "rules"), """+r AS (SELECT transaction_id, coalesce(sum(amount) FILTER (direction = 'CR') OVER w, 0)::DOUBLE AS credit, coalesce(sum(amount) FILTER (direction = 'DR') OVER w, 0)::DOUBLE AS debit FROM tx
 WHERE direction IN ('CR', 'DR') WINDOW w AS (PARTITION BY account_id ORDER BY transaction_date RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW))
 SELECT transaction_id, round_even(debit / credit, 6) AS ratio, 'rapid_layering' AS preset, 'ratio=0.95' AS rules FROM r WHERE credit > 0 AND debit / credit >= 95e-2""")
