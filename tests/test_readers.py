"""Readers of files, and rules of theirs that the registered queries do not reach."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from linkspark.operators import casework as W
from linkspark.operators import ingest as I
from linkspark.operators import patterns as P
from linkspark.sources import files


def test_layouts_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("Report of X\n\nTarget A Party Number,B Party Number,Call Date,CIT\n'9876543210',\"919812345678\",05-03-2024,10:00:00\n")
    (tmp_path / "sub" / "b.csv").write_text("Mobile No,Other Party No,DATE,TIME,Call Type\n9876543211,VD-X,06/03/2024,11:00:00,SMO\n")
    (tmp_path / "UNIFIED_MASTER.csv").write_text("A_PARTY,B_PARTY,CALL_DATE\n1,2,3\n")
    found = files.read_mixed_cdr(spark, str(tmp_path))
    rows = sorted(tuple(r) for r in found.select("A_PARTY", "B_PARTY", "CALL_DATE", "CALL_TIME", "CALL_TYPE").collect())
    assert rows == [("9876543210", "9812345678", "05-03-2024", "10:00:00", None), ("9876543211", "VD-X", "06/03/2024", "11:00:00", "SMS OUTGOING")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and "Exchange" not in plan and "Join" not in plan


def test_the_last_row_of_an_event_wins(spark):
    rows = [("9876543210", "a", "1"), ("9876543210", "b", "2"), ("9876543210", "c", "0")]
    df = spark.createDataFrame(rows, "a string, b string, place string").select(F.col("a").alias("A_PARTY"), F.col("b").alias("B_PARTY"), *[F.lit(None).cast("string").alias(c) for c in files.CDR_COLUMNS[2:]], "place")
    assert [r["b_party"] for r in files.cdr_events(df, "f", "place").collect()] == ["b"]


def test_session_headers_and_hash(spark):
    one = spark.createDataFrame([("IPV4", "10.0.0.1", "05/03/2024", "9:05:07", "+91 98765-43210")], ["IP", "VALUE", "F DATE", "F TIME", "Mobile"])
    r = files.ipdr_events(one).first()
    assert (r["ip_address"], r["msisdn"], str(r["event_at"]), r["duration_sec"]) == ("10.0.0.1", "9876543210", "2024-03-05 09:05:07", None)
    import hashlib

    key = "|".join(["9876543210", "", "", "", "", "10.0.0.1", "", "", "2024-03-05", "09:05:07", "2024-03-05", "00:00:00"])
    assert r["event_hash"] == hashlib.sha256(key.encode()).hexdigest()[:16]
    two = spark.createDataFrame([("1", "10.0.0.2", "9876543210")], ["No.", "IP Address", "Mobile"])
    assert files.ipdr_events(two).first()["msisdn"] == "9876543210"


def test_statement_lines(spark):
    lines = ["01-02-2024 UPI pay 1,000.00 0.00 5,000.00Cr", "02-02-2024 6,000.00Cr", "03-02-2024 got 500.00 6,500.00Cr", "04-02-2024 fee 20.00", "05-02-2024 two 5.00 7.00", "06-02-2024 back 9.00Cr 6,400.00Cr", "07-02-2024 Page Total 1.00", "no date 5.00"]
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(lines)], "doc string, line_no int, value string")
    got = [(r["line_no"], float(r["amount"]), r["direction"]) for r in files.statement_lines(df).orderBy("line_no").collect()]
    assert got == [(0, 1000.0, "DR"), (2, 500.0, "CR"), (3, 20.0, "DR"), (4, 5.0, "DR"), (5, 9.0, "DR")]


def test_bank_table_needs_a_date(spark):
    with pytest.raises(ValueError):
        files.bank_table(spark.createDataFrame([("x",)], ["Remark"]))


def test_account_hints_hold_and_end(spark):
    hints = spark.createDataFrame([("a", "A/c No: 123456789"), ("b", "000000123456789012"), ("c", "x 987654321 y")], "doc string, text string")
    accounts = spark.createDataFrame([("in", "55123456789012"), ("end", "123456789012")], "account_id string, account_number string")
    assert sorted(tuple(r) for r in I.account_matches(hints, accounts).collect()) == [("a", "end"), ("a", "in"), ("b", "end"), ("b", "in")]


def test_case_texts(spark):
    none = W.active_case(spark.createDataFrame([], "case_id string, status string")).collect()
    assert [tuple(r) for r in none] == [("FIR-UNASSIGNED", "open")]
    p = spark.sql("select 'E' entity_id, 'Ann' entity_name, 'SINK' role, 150000d inflow, 20d outflow, 0.1d ratio, 4 tx_count, 3 span, 0.62d confidence, array(named_struct('evidence', 'Terminal sink', 'points', 8)) `table`")
    assert W.narrative(p).first()["narrative"] == "Ann: SINK. In ₹1.50 L / out ₹20 (10% pass-through, 4 txns, 3d span). Indicators: Terminal sink. Confidence 62%."
    assert spark.range(1).select(W.safe_name(F.lit("a/b/FIR:1?.pdf"))).first()[0] == "FIR_1_.pdf"


def test_a_caller_without_an_entity_meets_the_largest_transfer_near(spark):
    tel = spark.sql("select 'C1' event_id, 'CDR' event_type, '1' msisdn, timestamp_ntz'2024-03-05 10:00:30' event_at, '9' b_party, 'OUTGOING' call_type, 5 duration_sec")
    ent = spark.sql("select 'E2' entity_id, '2' phone")
    acc = spark.sql("select 'A' account_id, 'E2' entity_id")
    rows = [("T1", "09:50:30", 5), ("T2", "10:10:30", 9), ("T3", "10:10:31", 99), ("T4", "09:50:29", 99), ("T5", "10:00:31", 7)]
    tx = spark.createDataFrame(rows, "transaction_id string, c string, amount int").selectExpr("transaction_id", "'A' account_id", "cast(concat('2024-03-05 ', c) as timestamp_ntz) transaction_date", "amount", "'' narration")
    got = P.call_transfer_correlation(SimpleNamespace(tel=tel, ent=ent, acc=acc, tx=tx)).collect()
    assert [(r["event_id"], r["transaction_id"], r["entity_id"]) for r in got] == [("C1", "T2", "E2")]


def test_nearest_sessions_are_the_brute_ones(spark):
    import random

    rnd = random.Random(5)
    points = [(rnd.choice("ab"), rnd.randint(0, 9000)) for _ in range(60)]
    sites = [(rnd.choice("ab"), rnd.randint(0, 9000), f"s{i:03d}") for i in range(80)]
    p = spark.createDataFrame(points, "k string, at long")
    s = spark.createDataFrame(sites, "k string, at long, id string").select("k", "at", F.struct("id").alias("site"))
    got = {(r["k"], r["at"]): (r["gap_sec"], r["site"]["id"]) for r in P.nearest_in_time(p, s, ["k"], 200).collect()}
    want = {}
    for k, at in points:
        near = [(abs(t - at), i) for kk, t, i in sites if kk == k and abs(t - at) <= 200]
        if near:
            want[k, at] = min(near)
    assert got == want


def test_places_are_worked_out_once_an_entity(spark):
    """No inferred filter works them out again, for every event below the distinct entities."""
    from linkspark.registry import QUERIES

    plan = QUERIES["header_assignment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 1


def test_statements_of_nothing_and_of_no_day(spark, tmp_path):
    """A credit of 0 without a word for its direction, and a transfer without a moment."""
    import duckdb

    from linkspark.registry import ORACLE_SQL, QUERIES

    duck = duckdb.connect()
    duck.sql(f"""copy (select i::bigint as event_id, case when i <> 5 then timestamp '2024-01-31 10:00:00' + interval (i) hour end as ts, (i % 4 + 1)::bigint as user_id,
     case when i % 2 = 0 then 'purchase' else 'signup' end as event_type, case when i % 5 < 3 then 0e0 else i * 1.25e0 end as value, '{{"k": ' || i || '}}' as props from range(24) as r(i)) to '{tmp_path}/events.parquet' (format parquet)""")
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = duck.sql(ORACLE_SQL["read_statements"])
    rows = [dict(zip(want.columns, map(str, r), strict=True)) for r in want.fetchall()]
    got = [{c: str(r[c]) for c in want.columns} for r in QUERIES["read_statements"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    both = spark.sql("select 's' statement_id, array(named_struct('transaction_id', 't', 'credit_amount', 0d, 'debit_amount', 0d)) transactions").selectExpr("to_json(struct(*)) j").select(F.from_json("j", files.STATEMENT).alias("d")).select("d.*")
    assert [r["direction"] for r in files.statements(both)[1].collect()] == ["DR"]
