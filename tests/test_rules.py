"""Scalar rules, scoring edges, ingest and streams on crafted rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linkspark.functions import scalars as X
from linkspark.operators import classify as C
from linkspark.operators import ingest as I
from linkspark.operators import scoring as S
from linkspark.operators.interval import interval_join
from linkspark.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("rule", "text", "expected"),
    [
        (X.norm_phone, "+919876543210", "9876543210"),
        (X.norm_phone, "09876543210", "9876543210"),
        (X.norm_phone, "9123456789", "9123456789"),
        (X.norm_phone_legacy, "9123456789", "23456789"),
        (X.party_phone, "VD-ALERT", "VD-ALERT"),
        (X.party_phone, "919876543210", "9876543210"),
        (X.strict_msisdn, "12345", None),
        (X.seconds, "75", 75),
        (X.seconds, "01:15", 75),
        (X.seconds, "00:01:15", 75),
        (X.seconds, "x", None),
        (X.number, "1,23,456.50", 123456.5),
        (X.number, "-", 0.0),
        (X.number, "nan", 0.0),
        (X.iso_date, "1-2-2024", "2024-02-01"),
        (X.iso_date, "2024/2/1 x", "2024-02-01"),
        (X.call_type, "smt", "SMS INCOMING"),
        (X.scrub, "=\"'12'\"", "12"),
        (C.header_kind, "A Party,B Party,Call Type", "cdr"),
        (C.header_kind, "Name,Remark", "quarantine"),
        (C.filename_kind, "FIR-2026-0417_9876543210.csv", "cdr"),
        (C.filename_kind, "ICORE_STMT_123456789012.xlsx", "bank"),
    ],
)
def test_scalar(spark, rule, text, expected):
    assert value(spark, rule(F.lit(text))) == expected


@pytest.mark.parametrize("text", ["2024-03-05 10:11:12", "05-03-2024 10:11:12", "05/03/2024 10:11:12"])
def test_moment(spark, text):
    assert value(spark, X.moment(F.lit(text)).cast("string")) == "2024-03-05 10:11:12"


def test_documents_are_read_whole(spark):
    made = [("far", "x " * 6000 + "bank statement"), ("blanks", " " * 9000 + "bank statement"), ("none", " " * 9000)]
    got = {r["doc_id"]: (r["bank"], r["category"], r["status"]) for r in C.documents(spark.createDataFrame(made, "doc_id string, text string")).collect()}
    assert got == {"far": (7, "bank", "classified"), "blanks": (7, "bank", "classified"), "none": (0, "quarantine", "quarantined")}


def test_moment_of_no_date(spark):
    assert value(spark, X.moment(F.lit("31-02-2024"))) is None


@pytest.mark.parametrize(("amount", "expected"), [(999, "₹999"), (123456, "₹1.23 L"), (12345678, "₹1.23 Cr")])
def test_rupees(spark, amount, expected):
    assert value(spark, X.rupees(F.lit(amount).cast("double"))) == expected


def test_half_even(spark):
    assert value(spark, X.is_round(F.lit(5000.5)))


def crafted(spark, rows, n, seed):
    schema = "entity_id string, found array<struct<evidence:string,bucket:string,points:int>>, tx_count int, cdr int, ipdr int, is_seed boolean"
    return S.rescaled(spark.createDataFrame([("e", rows, n, 0, 0, seed)], schema)).first()


def test_rescale_drops_zeros_and_puts_drift_first(spark):
    rows = [("Pass-through", "behavior", 24), ("Fan-in collector", "behavior", 12), ("Case-high volume", "transactions", 16), ("High velocity", "transactions", 1), ("FIR-named party + independent indicators", "case_link", 8)]
    r = crafted(spark, rows, 2, True)  # capped at 40 of 61
    assert r["total"] == 40 == sum(x["points"] for x in r["table"])
    assert [x["evidence"] for x in r["table"]] == [e for e, _, _ in rows]
    assert r["table"][-1]["bucket"] == "identifiers"


def test_no_rescale_under_the_cap(spark):
    r = crafted(spark, [("Pass-through", "behavior", 24)], 30, False)
    assert (r["total"], r["confidence"]) == (24, 0.95)


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, None, 1)], "k int, v string, o int")
    once = I.upsert(old, new, ["k"], ["o"])
    twice = I.upsert(once, new, ["k"], ["o"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 0), (2, "d", 2), (3, None, 1)]


def test_purge_after_insert_restores(spark):
    old = spark.createDataFrame([(1,), (2,)], "k int")
    added = I.insert_missing(old, spark.createDataFrame([(2,), (3,), (3,)], "k int").withColumn("o", F.lit(1)), ["k"], ["o"])
    assert [r["k"] for r in added.collect()] == [3]
    assert I.purge(old.unionByName(added.select("k")), added, ["k"]).count() == 2


def test_interval_join_is_the_cross_join(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    left = spark.createDataFrame([(k, t(i * 37 % 5000)) for k in (1, 2) for i in range(60)], "k int, a timestamp_ntz")
    right = spark.createDataFrame([(k, t(i * 53 % 5000)) for k in (1, 2) for i in range(60)], "k int, b timestamp_ntz")
    met = interval_join(left, right, ["k"], "a", "b", -300, 120)
    brute = left.join(right, "k").where("timestampdiff(SECOND, a, b) between -300 and 120")
    assert met.count() == brute.count() > 0


def test_operator_layouts_unify(spark):
    one = spark.createDataFrame([("'9876543210'", '="919812345678"', "05-03-2024", "10:00:00", "75", "OUT", "12.9/77.5")], ["Target A Party Number", "Called Party Telephone Number", "Call Date", "Call Initiation Time CIT", "Dur(s)", "Call Type", "First CGI Lat/Long"])
    r = files.unified_cdr(one).first()
    assert (r["A_PARTY"], r["B_PARTY"], r["CALL_TYPE"], r["LATITUDE"], r["LONGITUDE"], r["DURATION"]) == ("9876543210", "9812345678", "OUTGOING", "12.9", "77.5", "75")
    e = files.cdr_events(files.unified_cdr(one.union(one)), "f.csv")
    assert e.count() == 1 and e.first()["event_id"].startswith("CDR_")


def test_ipdr_keeps_unknown_headers(spark):
    df = spark.createDataFrame([("9876543210.0", "10.0.0.1", "01-02-2024", "10:00:00", "01-02-2024", "10:05:00", "x")], ["Msisdn", "Ip Address", "Start Date", "Start Time", "End Date", "End Time", "Odd"])
    r = files.ipdr_events(df).first()
    assert (r["msisdn"], r["duration_sec"], r["extra"]) == ("9876543210", 300, {"Odd": "x"})


def test_bank_layout(spark):
    df = spark.createDataFrame([("05-03-2024", "UPI x", "1,000.00", "", "A1"), ("06-03-2024", "NEFT", "", "250", "A1")], ["Tran Date", "Narration", "Dr Amt", "Cr Amt", "AC No"])
    assert sorted((float(r["amount"]), r["direction"]) for r in files.bank_table(df).collect()) == [(250.0, "CR"), (1000.0, "DR")]


def test_statement_lines_use_the_balance(spark):
    rows = [("d", 1, "01-02-2024 opening balance 5,000.00Cr"), ("d", 2, "01-02-2024 pay 1,000.00 4,000.00Cr"), ("d", 3, "02-02-2024 got 500.00 4,500.00Cr"), ("d", 4, "03-02-2024 pay 100.00 4,400.00Cr")]
    got = files.statement_lines(spark.createDataFrame(rows, "doc string, line_no int, value string")).orderBy("line_no").collect()
    assert [(float(r["amount"]), r["direction"]) for r in got][1:] == [(500.0, "CR"), (100.0, "DR")]


def test_the_inventory_scores_a_text_once(spark):
    """Neither its parts nor inferred filters score the texts again."""
    docs = spark.createDataFrame([(i, ["Bank statement", " x ", ""][i % 3]) for i in range(100)], "doc_id long, text string")
    found = C.inventory(C.documents(docs).withColumn("name", F.format_string("d%03d", "doc_id")), "name", 2)
    assert "contains(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {(r["category"], r["n"], r["names"]) for r in found.collect()} == {("bank", 34, "d000,d003"), ("other", 33, "d001,d004"), ("quarantine", 33, "d002,d005")}


def test_the_latest_row_holds_no_column_twice(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "a"), (2, 1, "z")], "k long, at long, v string")
    best = I.latest(rows, ["k"], ["k", "at"])
    assert {tuple(r) for r in best.collect()} == {(1, 7, "b"), (2, 1, "z")}
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_row") == 0 and plan.count("struct(at, at#") == 1
