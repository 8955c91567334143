"""Kept tables: what a commit rewrites, repeats, and what an interrupted one leaves; and
the streams that write and join."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linkspark.operators import patterns as P
from linkspark.sources.tables import Tables
from linkspark.streaming import events

START = dt.datetime(2024, 1, 1)


def made(spark, tmp_path, n=4000):
    rows = spark.range(n).select(F.format_string("e%05d", "id").alias("event_id"), F.expr("timestamp'2024-01-01' + make_interval(0, cast(id * 12 div 4000 as int))").alias("at"), F.col("id").cast("int").alias("v"))
    kept = Tables(spark, str(tmp_path / "kept"))
    kept.create("events", rows.schema, ["event_id"], by={"month": "date_format(at, 'yyyy-MM')"}, buckets=8)
    kept.upsert("events", rows, ["v"], "first")
    return kept, rows


def folders(kept):
    return kept.latest()["tables"]["events"]["parts"]


def test_a_small_load_rewrites_few_parts(spark, tmp_path):
    kept, rows = made(spark, tmp_path)
    before = folders(kept)
    newest = rows.where("v >= 3960").withColumn("v", -F.col("v"))  # one key in a hundred
    report = kept.upsert("events", newest.unionByName(newest.limit(0)), ["v"], "second")
    after = folders(kept)
    assert len(before) == 96 and report["parts_written"] == sum(before.get(p) != d for p, d in after.items()) == 8
    want = {f"e{i:05d}": -i if i >= 3960 else i for i in range(4000)}
    assert {r["event_id"]: r["v"] for r in kept.read("events").collect()} == want
    assert kept.read("events", lambda p: p.startswith("2024-12~")).count() == rows.where("month(at) = 12").count()


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    kept, rows = made(spark, tmp_path, 300)
    before = kept.latest()
    assert kept.upsert("events", rows.withColumn("v", F.lit(0)), ["v"], "first")["parts_written"] == 0
    assert kept.latest() == before and kept.read("events").agg(F.sum("v")).first()[0] == 299 * 150
    null = rows.limit(1).withColumn("event_id", F.lit(None).cast("string"))
    kept.insert_missing("events", null.unionByName(rows.limit(5)), ["v"], "third")
    assert kept.read("events").count() == 300
    with pytest.raises(ValueError):
        kept.create("events", rows.schema, ["event_id"])


def test_an_interrupted_purge_is_not_seen(spark, tmp_path, monkeypatch):
    kept, rows = made(spark, tmp_path, 500)
    kept.create("notes", rows.schema, ["event_id"], buckets=4)
    kept.upsert("notes", rows, ["v"])
    linked = {"events": (rows.where("v < 100"), ["event_id"]), "notes": (rows.where("v < 7"), ["event_id"])}

    def lost(*_):
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(Tables, "_commit", lost)
        with pytest.raises(RuntimeError):
            kept.purge(linked, "doc")
    assert (kept.read("events").count(), kept.read("notes").count()) == (500, 500)
    report = {r["table"]: (r["before"], r["after"]) for r in kept.purge(linked, "doc").collect()}
    assert report == {"events": (500, 400), "notes": (500, 493)} == {r["table"]: (r["before"], r["after"]) for r in kept.purge(linked, "doc").collect()}
    assert (kept.read("events").count(), kept.read("notes").count()) == (400, 493)
    assert kept.tidy() >= 2 and kept.read("events").count() == 400


def test_of_two_commits_at_once_one_fails(spark, tmp_path):
    kept, _ = made(spark, tmp_path, 50)
    before = kept.latest()
    kept._commit(before, {}, None, {})
    with pytest.raises(Exception, match="exist"):
        kept._commit(before, {}, None, {})


def test_stream_into_a_table(spark, tmp_path):
    schema = "event_id string, event_at timestamp, v int"
    load = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    kept = Tables(spark, str(tmp_path / "kept"))
    kept.create("t", spark.createDataFrame([], schema).schema, ["event_id"], buckets=4)

    def run(checkpoint):
        stream = events.fresh(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")))
        q = events.upsert_into(stream, kept, "t", ["event_at", "v"], str(tmp_path / checkpoint))
        q.processAllAvailable()
        q.stop()
        return {r["event_id"]: r["v"] for r in kept.read("t").collect()}

    load("a", [("a", START, 1), ("a", START, 1), ("b", START, 2)])
    assert run("ck") == {"a": 1, "b": 2}
    load("b", [("b", START + dt.timedelta(hours=2), 3), ("c", START, 4)])
    assert run("ck")["c"] == 4
    version = kept.latest()["version"]
    assert run("ck") and kept.latest()["version"] == version
    # another checkpoint reads all again and starts at batch 0: the table stays whole
    assert set(run("other")) == {"a", "b", "c"}


def test_stream_of_transfers_with_and_without_calls(spark, tmp_path):
    at = lambda m, s=0: START + dt.timedelta(minutes=m, seconds=s)
    calls = [("E1", "c1", at(10)), ("E1", "c2", at(12)), ("E2", "c3", at(10)), ("E1", "c4", at(100)), ("E3", "c5", at(200))]
    pays = [("E1", "t1", at(20)), ("E1", "t2", at(12)), ("E2", "t3", at(30)), ("E1", "t4", at(115)), ("E4", "t5", at(40)), ("E3", "t6", at(200)), ("E3", "t7", at(215, 1)), ("E1", "t8", at(115, 1))]
    # rows of later files push the watermarks; a call of the past is too late by then
    files = [(calls[:3], pays[:3]), (calls[3:], pays[3:]), ([("X", "x", at(900))], [("X", "y", at(100_000))]), ([("E4", "late", at(39)), ("X", "z", at(100_000))], [("X", "w", at(100_001))]), ([("X", "q", at(100_002))], [("X", "v", at(100_003))])]
    for i, (c, p) in enumerate(files):
        spark.createDataFrame(c, "entity_id string, event_id string, call_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        spark.createDataFrame(p, "entity_id string, transaction_id string, transaction_date timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    read = lambda d, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / d))
    met = events.call_then_transfer(read("c", "entity_id string, event_id string, call_at timestamp"), read("p", "entity_id string, transaction_id string, transaction_date timestamp"))
    q = met.writeStream.format("memory").queryName("met").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    held = [s["numRowsTotal"] for s in q.lastProgress["stateOperators"]]
    q.stop()
    got = {(r["transaction_id"], r["event_id"]) for r in spark.table("met").where("entity_id <> 'X'").collect()}
    c = spark.createDataFrame(calls, "entity_id string, event_id string, call_at timestamp")
    p = spark.createDataFrame(pays, "entity_id string, transaction_id string, transaction_date timestamp")
    batch = P.interval_join(p, c, ["entity_id"], "transaction_date", "call_at", -900, 0).where("call_at < transaction_date")
    pairs = {(r["transaction_id"], r["event_id"]) for r in batch.collect()}
    assert got == pairs | {(t, None) for _, t, _ in pays if t not in {x for x, _ in pairs}}
    assert len(pairs) == 4 and max(held) < 8
