"""Queries over the ledger and telecom events: aggregates, browsing, patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import browse as B
from ..operators import patterns as P
from ..sources.views import DUCK, evidence

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, plan, sql: str | None = None) -> None:
    """``plan`` maps the evidence to a frame; ``sql`` follows the common head."""
    QUERIES[name] = lambda spark, sf_dir: plan(evidence(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = DUCK + (", " if sql.lstrip().split(" ", 2)[1:2] == ["AS"] or sql.lstrip().startswith("+") else " ") + sql.lstrip().removeprefix("+")


NZ = "coalesce({}, 0)::DOUBLE"
DEST = "coalesce(nullif(trim(counterparty_account), ''), nullif(trim(counterparty_name), ''))"
OWNED = "+own AS (SELECT t.*, a.entity_id, a.is_seed FROM tx t JOIN acc a USING (account_id))"

query("overview_stats", A.overview, """SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM ent WHERE is_seed) AS seeds, (SELECT count(*) FROM acc) AS accounts,
 count(*) AS transactions, count(*) FILTER (direction = 'CR') AS credit_count, coalesce(sum(amount) FILTER (direction = 'CR'), 0)::DOUBLE AS credit_total,
 count(*) FILTER (direction = 'DR') AS debit_count, coalesce(sum(amount) FILTER (direction = 'DR'), 0)::DOUBLE AS debit_total,
 (SELECT count(*) FROM tel WHERE event_type = 'CDR') AS cdr, (SELECT count(*) FROM tel WHERE event_type = 'IPDR') AS ipdr FROM tx""")
query("tx_by_direction", A.by_direction, OWNED + " SELECT entity_id, direction, count(*) AS n, sum(amount)::DOUBLE AS total FROM own GROUP BY 1, 2")
query("top_counterparties", A.top_counterparties, OWNED + """, g AS (SELECT entity_id, counterparty_name, count(*) AS n, sum(amount)::DOUBLE AS total FROM own WHERE counterparty_name IS DISTINCT FROM '' GROUP BY 1, 2)
 SELECT *, (row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, total DESC, counterparty_name))::INT AS rank FROM g QUALIFY rank <= 10""")
query("telecom_by_type", lambda ev: A.telecom_by_type(ev).withColumn("volume", F.bround("volume", 3)), """SELECT e.entity_id, t.event_type, count(*) AS n, coalesce(sum(duration_sec) FILTER (event_type = 'CDR'), 0)::BIGINT AS duration,
 round_even(coalesce(sum(data_volume_up + data_volume_down) FILTER (event_type <> 'CDR'), 0), 3)::DOUBLE AS volume FROM tel t JOIN ent e ON t.msisdn = e.phone GROUP BY 1, 2""")
CP = "CASE WHEN upper(trim(coalesce(counterparty_account, counterparty_name))) NOT IN ('', 'NONE', 'NULL', 'UNKNOWN', 'NA', '-') THEN trim(coalesce(counterparty_account, counterparty_name)) END"
STATS = f"""+st AS (SELECT account_id, count(*) AS tx_count, coalesce(sum(amount) FILTER (direction = 'CR'), 0)::DOUBLE AS inflow, coalesce(sum(amount) FILTER (direction = 'DR'), 0)::DOUBLE AS outflow,
 count(*) FILTER (direction = 'CR') AS in_count, count(*) FILTER (direction = 'DR') AS out_count,
 coalesce(list_sort(list_filter(list(DISTINCT CASE WHEN direction = 'CR' THEN {CP} END), lambda x: x IS NOT NULL)), []) AS in_parties, coalesce(list_sort(list_filter(list(DISTINCT CASE WHEN direction = 'DR' THEN {CP} END), lambda x: x IS NOT NULL)), []) AS out_parties,
 min(transaction_date) AS first_at, max(transaction_date) AS last_at, count(*) FILTER (amount >= 5000 AND round_even(amount, 0) % 5000 = 0) AS round_count FROM tx GROUP BY 1)"""
query("account_stats", lambda ev: A.account_stats(ev.tx).withColumns({c: F.array_join(c, ",") for c in ("in_parties", "out_parties")}), STATS + """ SELECT * REPLACE (array_to_string(in_parties, ',') AS in_parties, array_to_string(out_parties, ',') AS out_parties) FROM st""")
query("entity_stats", lambda ev: A.entity_stats(ev.tx, ev.acc), STATS + """ SELECT entity_id, sum(tx_count)::BIGINT AS tx_count, sum(inflow) AS inflow, sum(outflow) AS outflow, sum(in_count)::BIGINT AS in_count, sum(out_count)::BIGINT AS out_count,
 len(list_distinct(flatten(list(in_parties))))::INT AS in_parties, len(list_distinct(flatten(list(out_parties))))::INT AS out_parties, min(first_at) AS first_at, max(last_at) AS last_at, sum(round_count)::BIGINT AS round_count FROM st JOIN acc USING (account_id) GROUP BY 1""")
query("telecom_stats", lambda ev: A.telecom_stats(ev.tel), "SELECT msisdn AS phone, count(*) FILTER (event_type = 'CDR') AS cdr, count(*) FILTER (event_type = 'IPDR') AS ipdr, min(event_at) AS first_at, max(event_at) AS last_at FROM tel WHERE msisdn <> '' GROUP BY 1")
HUBS = f"SELECT {DEST} AS dest, count(DISTINCT account_id) AS sources, count(*) AS transfers, sum(amount)::DOUBLE AS amount"
query("fan_in_hubs", lambda ev: A.fan_in_hubs(ev.tx), HUBS + " FROM tx GROUP BY 1 HAVING dest IS NOT NULL AND count(DISTINCT account_id) >= 3 ORDER BY amount DESC, dest LIMIT 15")
query("seed_convergence", lambda ev: A.seed_convergence(ev.tx, ev.acc), f"""+legs AS (SELECT t.* FROM tx t JOIN acc a USING (account_id) WHERE a.is_seed), debit AS ({HUBS} FROM legs WHERE direction IN ('DR', 'DEBIT', 'OUT') GROUP BY 1 HAVING dest IS NOT NULL AND sources >= 2),
 every AS ({HUBS} FROM legs GROUP BY 1 HAVING dest IS NOT NULL AND sources >= 2) SELECT * FROM debit UNION ALL SELECT * FROM every WHERE NOT EXISTS (SELECT 1 FROM debit)""")
query("structuring", lambda ev: A.structuring(ev.tx), "SELECT account_id, count(*) AS n, sum(amount)::DOUBLE AS total FROM tx WHERE amount >= 40000 AND amount < 50000 GROUP BY 1 HAVING count(*) >= 3")
query("seed_networks", A.seed_networks, OWNED + """, g AS (SELECT entity_id, coalesce(counterparty_name, counterparty_account) AS party, sum(amount) AS total FROM own WHERE is_seed GROUP BY 1, 2),
 top AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY total DESC, party) <= 20)
 SELECT entity_id, count(*) AS nodes, least(8, greatest(1, count(*) // 3))::BIGINT AS high_risk, sum(total)::DOUBLE AS traced FROM top GROUP BY 1""")
query("money_flow", lambda ev: A.money_flow(ev.tx), """+g AS (SELECT account_id AS source, coalesce(nullif(trim(counterparty_name), ''), nullif(trim(counterparty_account), '')) AS target, sum(amount)::DOUBLE AS amount, count(*) AS n FROM tx GROUP BY 1, 2),
 top AS (SELECT * FROM g WHERE target IS NOT NULL AND upper(target) <> 'UNKNOWN' ORDER BY amount DESC, source, target LIMIT 50) SELECT *, greatest(4.0, round_even(100 * amount / max(amount) OVER (), 4))::DOUBLE AS width FROM top""")
query("ipdr_top_ips", lambda ev: A.ip_sessions(ev.tel), "SELECT ip_address, count(*) AS sessions, coalesce(string_agg(DISTINCT nullif(msisdn, ''), ',' ORDER BY nullif(msisdn, '')), '') AS phones FROM tel WHERE event_type = 'IPDR' AND ip_address <> '' GROUP BY 1 ORDER BY sessions DESC, ip_address LIMIT 20")
query("ipdr_top_phones", lambda ev: A.phone_sessions(ev.tel), "SELECT msisdn, count(*) AS sessions, round_even(sum(data_volume_up), 3) AS up, round_even(sum(data_volume_down), 3) AS down FROM tel WHERE event_type = 'IPDR' AND msisdn <> '' GROUP BY 1 ORDER BY sessions DESC, msisdn LIMIT 20")
query("ipdr_totals", lambda ev: A.ipdr_totals(ev.tel), "SELECT count(*) AS total, count(*) FILTER (msisdn <> '') AS with_phone, count(DISTINCT ip_address) AS addresses FROM tel WHERE event_type = 'IPDR'")
query("case_stats", A.case_stats, """SELECT c.case_id, (SELECT count(*) FROM acc a JOIN cases x USING (entity_id) WHERE x.case_id = c.case_id) AS accounts, count(*) AS seeds,
 (SELECT count(*) FROM tx JOIN acc USING (account_id) JOIN cases x USING (entity_id) WHERE x.case_id = c.case_id) AS transactions,
 (SELECT count(*) FROM tel t JOIN ent e ON t.msisdn = e.phone JOIN cases x USING (entity_id) WHERE x.case_id = c.case_id AND event_type = 'CDR') AS cdr,
 (SELECT count(*) FROM tel t JOIN ent e ON t.msisdn = e.phone JOIN cases x USING (entity_id) WHERE x.case_id = c.case_id AND event_type = 'IPDR') AS ipdr FROM cases c GROUP BY 1""")
NORMS = STATS + """, nv AS (SELECT 'inflow' AS measure, inflow AS value FROM st UNION ALL SELECT 'outflow', outflow FROM st UNION ALL
 SELECT 'per_day', tx_count / greatest(1, date_diff('day', first_at::DATE, last_at::DATE) + 1) FROM st), norm AS (SELECT measure, value, count(*) AS n FROM nv WHERE value > 0 GROUP BY 1, 2)"""
query("case_norms", lambda ev: A.norms(ev.tx), NORMS + " SELECT * FROM norm")

query("entity_search", lambda ev: B.entities(ev.ent, "holder 1", True).select("entity_id", "entity_name", "is_seed", F.array_join("phones", ",").alias("phones")), "SELECT entity_id, entity_name, is_seed, phone AS phones FROM ent WHERE is_seed AND (contains(lower(entity_id), 'holder 1') OR contains(lower(entity_name), 'holder 1') OR contains(phone, 'holder 1'))")
query("account_search", lambda ev: B.accounts(ev.acc, "_b"), "SELECT account_id, entity_id, entity_name, is_seed, phone FROM acc WHERE contains(lower(account_id), '_b') OR contains(lower(entity_id), '_b') OR contains(lower(entity_name), '_b') OR contains(phone, '_b')")
query("ledger_page", lambda ev: B.ledger_page(ev.tx, text="party 1", direction="dr", page=2, size=50), """SELECT transaction_id, account_id, transaction_date, amount::DOUBLE AS amount, direction, coalesce(nullif(trim(counterparty_name), ''), substr(narration, 1, 60)) AS name,
 CASE WHEN mode = '' THEN '—' ELSE mode END AS mode, CASE WHEN extract(hour FROM transaction_date) + extract(minute FROM transaction_date) + extract(second FROM transaction_date) = 0 THEN strftime(transaction_date, '%d-%b-%Y') ELSE strftime(transaction_date, '%d-%b-%Y %H:%M:%S') END AS shown
 FROM tx WHERE direction = 'DR' AND (contains(lower(transaction_id), 'party 1') OR contains(lower(account_id), 'party 1') OR contains(lower(narration), 'party 1') OR contains(lower(counterparty_name), 'party 1') OR contains(lower(counterparty_account), 'party 1') OR contains(lower(mode), 'party 1'))
 ORDER BY tx.transaction_date DESC, transaction_id DESC LIMIT 50 OFFSET 50""")
query("telecom_page", lambda ev: B.telecom_page(ev.tel, event_type="CDR", page=1, size=100), """SELECT event_id, event_type, msisdn, event_at, CASE WHEN event_type = 'IPDR' THEN ip_address ELSE b_party END AS party, CASE WHEN duration_sec >= 3600 THEN (duration_sec // 60) || 'm' ELSE duration_sec || 's' END AS duration
 FROM tel WHERE event_type = 'CDR' ORDER BY event_at DESC, event_id DESC LIMIT 100""")
query("page_counts", lambda ev: B.page_counts(ev.tx, size=50), "SELECT count(*) AS total, greatest(1, ceil(count(*) / 50.0))::BIGINT AS pages, count(*) > 50 AS has_next, false AS has_prev FROM tx")
query("recent_tx_per_entity", B.recent_tx, OWNED + " SELECT entity_id, transaction_id, transaction_date, amount::DOUBLE AS amount, (row_number() OVER (PARTITION BY entity_id ORDER BY transaction_date DESC, transaction_id DESC))::INT AS rank FROM own QUALIFY rank <= 10")
query("recent_telecom_per_entity", B.recent_telecom, "SELECT e.entity_id, t.event_id, t.event_at, (row_number() OVER (PARTITION BY e.entity_id ORDER BY t.event_at DESC, t.event_id DESC))::INT AS rank FROM tel t JOIN ent e ON t.msisdn = e.phone QUALIFY rank <= 10")
query("seed_accounts", B.seed_accounts, "SELECT entity_id, unnest(list_distinct([account_id, entity_id])) AS account_id FROM acc WHERE is_seed GROUP BY 1, 2 ORDER BY 1")
ORACLE_SQL["seed_accounts"] = DUCK + " SELECT entity_id, account_id FROM acc WHERE is_seed"
query("case_seeds", B.case_seeds, "SELECT case_id, count(*) AS seeds, string_agg(entity_id, ',' ORDER BY entity_id) AS ids FROM cases GROUP BY 1")
query("suspicious_tx", lambda ev: B.suspicious_tx(ev.tx), "SELECT transaction_id, account_id, direction, amount::DOUBLE AS amount FROM tx WHERE amount >= 100000 OR (direction = 'DR' AND amount >= 50000)")
query("suspicious_calls", lambda ev: B.suspicious_calls(ev.tel), "SELECT event_id, msisdn, b_party, duration_sec FROM tel WHERE event_type = 'CDR' AND ((call_type LIKE 'OUT%' AND duration_sec >= 300) OR duration_sec >= 1800 OR (length(b_party) BETWEEN 1 AND 4 AND call_type LIKE 'OUT%'))")
query("same_counterparty", B.same_counterparty, """SELECT x.transaction_id, y.transaction_id AS other, y.rank FROM tx x JOIN (SELECT transaction_id, counterparty_name,
 (row_number() OVER (PARTITION BY counterparty_name ORDER BY transaction_date DESC, transaction_id DESC))::INT AS rank FROM tx WHERE counterparty_name <> '' QUALIFY rank <= 10) y USING (counterparty_name)""")
query("phone_overlap", B.phone_overlap, "SELECT count(DISTINCT phone) AS phones FROM ent WHERE phone IN (SELECT msisdn FROM tel WHERE event_type = 'CDR')")

RATIO = """+r AS (SELECT transaction_id, account_id, transaction_date, coalesce(sum(amount) FILTER (direction = 'CR') OVER w, 0)::DOUBLE AS credit, coalesce(sum(amount) FILTER (direction = 'DR') OVER w, 0)::DOUBLE AS debit FROM tx
 WHERE direction IN ('CR', 'DR') WINDOW w AS (PARTITION BY account_id ORDER BY transaction_date RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW))"""
query("rapid_layering", lambda ev: P.rapid_layering(ev.tx), RATIO + " SELECT *, debit / credit AS ratio FROM r WHERE credit > 0 AND debit / credit >= 0.9")
query("convergence_48h", lambda ev: P.convergence(ev.tx, ev.acc), f"""+o AS (SELECT t.*, {DEST} AS dest, coalesce(a.is_seed, false) AS seed FROM tx t LEFT JOIN acc a USING (account_id) WHERE direction = 'DR')
 SELECT DISTINCT x.dest, x.transaction_date AS window_start, count(DISTINCT y.account_id)::INT AS sources, count(*) AS transfers, sum(y.amount)::DOUBLE AS amount FROM (SELECT DISTINCT dest, transaction_date FROM o) x
 JOIN o y ON x.dest = y.dest AND y.transaction_date BETWEEN x.transaction_date AND x.transaction_date + INTERVAL 48 HOURS GROUP BY 1, 2 HAVING count(DISTINCT y.account_id) >= 3 AND bool_or(y.seed)""")
CALLS = OWNED + ", calls AS (SELECT t.event_id, t.msisdn, t.event_at AS call_at, t.b_party, e.entity_id FROM tel t LEFT JOIN ent e ON t.msisdn = e.phone WHERE event_type = 'CDR')"
query("call_before_transfer", P.call_before_transfer, CALLS + """ SELECT o.entity_id, transaction_id, account_id, transaction_date, amount::DOUBLE AS amount, count(*) AS calls, string_agg(event_id, ',' ORDER BY event_id) AS call_ids FROM own o JOIN calls c ON c.entity_id = o.entity_id
 AND c.call_at >= transaction_date - INTERVAL 15 MINUTES AND c.call_at < transaction_date WHERE b_party <> '' GROUP BY 1, 2, 3, 4, 5""")
# a narration's clock, in the four forms that the ledger has
SAID_CLOCK = """CASE WHEN regexp_matches(narration, '[0-9]{1,2}:[0-9]{2}:[0-9]{2}') THEN transaction_date::DATE + regexp_extract(narration, '[0-9]{1,2}:[0-9]{2}:[0-9]{2}')::TIME
 WHEN try_strptime(regexp_extract(narration, '[0-9]{14}'), '%d%m%Y%H%M%S')::DATE = transaction_date::DATE THEN strptime(regexp_extract(narration, '[0-9]{14}'), '%d%m%Y%H%M%S')
 WHEN try_strptime(regexp_extract(narration, '[0-9]{14}'), '%Y%m%d%H%M%S')::DATE = transaction_date::DATE THEN strptime(regexp_extract(narration, '[0-9]{14}'), '%Y%m%d%H%M%S')
 WHEN regexp_extract(narration, '([0-9]{8})/[0-9]{6}', 1) = strftime(transaction_date, '%Y%m%d') THEN strptime(replace(regexp_extract(narration, '[0-9]{8}/[0-9]{6}'), '/', ''), '%Y%m%d%H%M%S') END"""
CORR = CALLS + f""", met AS (SELECT c.event_id, c.call_at, o.entity_id, o.transaction_id, o.transaction_date, o.amount::DOUBLE AS amount, o.narration,
 CASE WHEN abs(epoch(o.transaction_date) - epoch(c.call_at)) <= 600 THEN 1 ELSE 2 END AS tier FROM calls c JOIN own o ON c.entity_id = o.entity_id
 WHERE abs(epoch(o.transaction_date) - epoch(c.call_at)) <= 600 OR o.transaction_date::DATE = c.call_at::DATE),
 best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY tier, amount DESC, transaction_id DESC) = 1),
 told AS (SELECT *, transaction_date::TIME <> TIME '00:00:00' AS clock, {SAID_CLOCK} AS said FROM best),
 paid AS (SELECT *, abs(epoch(CASE WHEN clock THEN transaction_date ELSE said END) - epoch(call_at)) AS gap FROM told),
 corr AS (SELECT event_id, call_at, entity_id, transaction_id, transaction_date, amount, tier, coalesce(gap, 0)::BIGINT AS delta_sec,
 CASE WHEN clock THEN 'statement' WHEN said IS NOT NULL THEN 'narration' ELSE 'linked_cdr' END AS time_source,
 CASE WHEN gap IS NOT NULL THEN greatest(40.0, least(98.0, 100 - gap / 10)) ELSE 74.0 END::DOUBLE AS score FROM paid)"""
query("call_transfer_correlation", P.call_transfer_correlation, CORR + " SELECT * FROM corr")
query("nearest_ipdr", P.nearest_session, CORR + """, net AS (SELECT event_id AS session_id, msisdn AS user_no, event_at AS session_at, ip_address FROM tel WHERE event_type = 'IPDR'),
 near AS (SELECT c.event_id, n.session_id, n.ip_address, abs(epoch(n.session_at) - epoch(c.call_at))::BIGINT AS gap_sec, CASE WHEN abs(epoch(n.session_at) - epoch(c.call_at)) <= 7200 AND (n.user_no = k.msisdn OR n.user_no = '') THEN 1 ELSE 2 END AS tier
 FROM corr c JOIN calls k USING (event_id) JOIN net n ON n.session_at BETWEEN c.call_at - INTERVAL 6 HOURS AND c.call_at + INTERVAL 6 HOURS) SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY tier, gap_sec, session_id) = 1""")
