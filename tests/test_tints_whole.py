"""Tints count what is not drawn, too."""

from types import SimpleNamespace

from linkspark.operators import graph as G


def test_totals_beyond_the_drawn(spark):
    ent = spark.sql("select * from values ('E1', '1', true) t(entity_id, phone, is_seed)")
    acc = spark.sql("select * from values ('A1', 'E1') t(account_id, entity_id)")
    tx = spark.sql("select 'A1' account_id, 1.0 amount, 'DR' direction, if(id < 5, '', concat('D', id)) counterparty_account, '' counterparty_name from range(40)")
    tel = spark.sql("select '1' msisdn, 'CDR' event_type, concat('9', id % 30) b_party from range(60)")
    r = G.tints(SimpleNamespace(tel=tel, ent=ent, acc=acc, tx=tx)).first()
    assert (r["tx"], r["cps"], r["calls"]) == (40, 35, 30)
