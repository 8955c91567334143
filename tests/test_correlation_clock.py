"""A date-only transfer is scored by the clock in its narration."""

from types import SimpleNamespace

from linkspark.operators import patterns as P


def test_narration_clock(spark):
    tel = spark.sql("select * from values ('C1', 'CDR', '1', timestamp_ntz'2024-03-05 10:00:00', '9', 'OUTGOING', 5), ('C2', 'CDR', '2', timestamp_ntz'2024-03-05 10:00:00', '9', 'OUTGOING', 5), ('C3', 'CDR', '3', timestamp_ntz'2024-03-05 10:00:00', '9', 'OUTGOING', 5) t(event_id, event_type, msisdn, event_at, b_party, call_type, duration_sec)")
    ent = spark.sql("select * from values ('E1', '1'), ('E2', '2'), ('E3', '3') t(entity_id, phone)")
    acc = ent.selectExpr("concat('A', phone) account_id", "entity_id")
    tx = spark.sql("select * from values ('T1', 'A1', timestamp_ntz'2024-03-05 00:00:00', 5, 'POS AT 10:05:00'), ('T2', 'A2', timestamp_ntz'2024-03-05 00:00:00', 5, 'NEFT'), ('T3', 'A3', timestamp_ntz'2024-03-05 10:01:00', 5, 'POS AT 10:05:00') t(transaction_id, account_id, transaction_date, amount, narration)")
    got = {r["event_id"]: (r["delta_sec"], r["time_source"], r["score"]) for r in P.call_transfer_correlation(SimpleNamespace(tel=tel, ent=ent, acc=acc, tx=tx)).collect()}
    assert got == {"C1": (300, "narration", 70.0), "C2": (0, "linked_cdr", 74.0), "C3": (60, "statement", 94.0)}
