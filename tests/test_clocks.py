"""Clocks in the texts of a ledger row, and the middle clock of a day by counts."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from linkspark.functions import scalars as X
from linkspark.operators import timeline as T

DAY = dt.datetime(2024, 3, 5)


@pytest.mark.parametrize(
    ("text", "clock"),
    [
        ("paid at 9:05", "09:05:00"),
        ("AT12:30 no word ends there", None),
        ("12:30:61 keeps the minutes", "12:30:00"),
        ("05032024101112", "10:11:12"),
        ("20240305101112", "10:11:12"),
        ("06032024101112 05032024111213", "11:12:13"),
        ("ref 20240305/101112/20240305/222324", "10:11:12"),
        ("20240305 on 101112", "10:11:12"),
        ("20240305 only x 101112", None),
        ("20240305 and far away   101112", None),
        ("20240305-1011", None),
        ("20240305 99 99 99 20240305101112", "10:11:12"),
        ("", None),
    ],
)
def test_first_clock_of_the_day(spark, text, clock):
    got = spark.range(1).select(X.clock_from_text(F.lit(text), F.lit(DAY))).first()[0]
    assert (got and got.strftime("%H:%M:%S")) == clock


def test_day_first_stamps_count_from_2020_on(spark):
    got = lambda text, day: spark.range(1).select(X.clock_from_text(F.lit(text), F.lit(day).cast("timestamp"))).first()[0]
    assert got("05032019101112", dt.datetime(2019, 3, 5)) is None
    assert got("20190305101112", dt.datetime(2019, 3, 5)) == dt.datetime(2019, 3, 5, 10, 11, 12)
    assert got("05032024101112", None) == dt.datetime(2024, 3, 5, 10, 11, 12)
    assert got("at 10:11", None) is None


def test_six_fields_are_read(spark):
    for field in X.CLOCK_FIELDS:
        tx = spark.createDataFrame([("t", DAY, "05032024101112")], f"transaction_id string, transaction_date timestamp, {field} string")
        assert [r["time_source"] for r in T.resolved(tx).collect()] == ["narration"]
    none = spark.createDataFrame([("t", None, "x")], "transaction_id string, transaction_date timestamp, narration string")
    assert [r["time_source"] for r in T.resolved(none).collect()] == ["unknown"]


def test_middle_clock_of_many_events(spark):
    rnd = random.Random(2)
    rows = []
    for entity in range(5):
        for _ in range(rnd.choice([1, 2, 3, 400])):
            at = DAY + dt.timedelta(days=rnd.randint(0, 1), seconds=rnd.choice([3600, 7200, rnd.randint(1, 86_399)]))
            rows.append((f"p{entity}", at, rnd.choice(["CDR", "IPDR"])))
    rows += [("p0", DAY, "CDR")]  # a date alone is no clock
    tel = spark.createDataFrame(rows, "msisdn string, event_at timestamp, event_type string")
    ent = spark.createDataFrame([(f"E{i}", f"p{i}") for i in range(5)], "entity_id string, phone string")
    got = {(r["entity_id"], r["day"]): (r["mid"], r["has_cdr"]) for r in T.day_clocks(SimpleNamespace(tel=tel, ent=ent)).collect()}
    days = {}
    for phone, at, kind in rows:
        if at.time() != dt.time(0):
            days.setdefault((f"E{phone[1:]}", at.date()), []).append((at, kind))
    assert got == {k: (sorted(a for a, _ in v)[len(v) // 2], any(t == "CDR" for _, t in v)) for k, v in days.items()}


def test_two_places_by_the_exact_value(spark):
    rnd = random.Random(3)
    numbers = [1.125, 1.375, 0.975, 2.675, 1.005, 26.075, 0.0, 0.005, 0.015, -1.125, -0.001, 99.995, 1234567.885] + [rnd.randint(0, 10**6) / 1000 for _ in range(3000)] + [rnd.uniform(0, 1e6) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", X.two_places(F.col("x")).alias("t"))
    assert {r["x"]: r["t"] for r in df.collect()} == {x: f"{x:.2f}".replace("-0.00", "0.00") for x in numbers}
