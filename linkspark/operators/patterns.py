"""Pattern detectors: rolling windows, interval joins and nearest neighbours in time.

Rolling sums are running sums over the moments at which rows enter and leave a window;
they take one step for each row, however many rows a window holds. Histories are cut
into stretches of time, so that no account, destination or phone meets whole in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from .aggregates import owned, with_destination
from .interval import interval_join

HOUR = 3600
#: A stretch of time is so many windows long.
STRETCH = 4


def seconds(at: str) -> Column:
    return F.unix_timestamp(F.col(at).cast("timestamp"))


def running(steps: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """``steps`` (keys, at, sums, own), running sums up to each moment, at those that
    are ``own``: a row's own moment, and not one at which it leaves."""
    w = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumns({c: F.sum(c).over(w) for c in sums}).where("own")


def rapid_layering(tx: DataFrame, ratio: float = 0.9, hours: int = 24) -> DataFrame:
    """Ledger rows where an account's debits over the last day are most of its credits."""
    span = hours * HOUR
    width = STRETCH * span
    side = lambda d: F.when(F.col("direction") == d, F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)"))
    rows = tx.where(F.col("direction").isin("CR", "DR")).select("transaction_id", "account_id", "transaction_date", seconds("transaction_date").alias("sec"), side("CR").alias("credit"), side("DR").alias("debit"))
    cell = F.floor(F.col("sec") / width)
    # a row enters in its stretch, or at the edge of the next one that its window reaches,
    # and leaves a second after the window
    enters = rows.withColumn("cell", F.explode(F.array_distinct(F.array(cell, F.floor((F.col("sec") + span) / width))))).withColumn("at", F.col("sec")).withColumn("own", F.col("cell") == cell)
    leaves = enters.withColumn("at", F.col("sec") + span + 1).where(F.floor(F.col("at") / width) == F.col("cell"))
    leaves = leaves.withColumns({"credit": -F.col("credit"), "debit": -F.col("debit"), "own": F.lit(False)})
    got = running(enters.unionByName(leaves), ["account_id", "cell"], ["credit", "debit"])
    got = got.select("transaction_id", "account_id", "transaction_date", F.col("credit").cast("double").alias("credit"), F.col("debit").cast("double").alias("debit"))
    return got.withColumn("ratio", F.try_divide("debit", "credit")).where((F.col("credit") > 0) & (F.col("ratio") >= ratio))


def convergence(tx: DataFrame, acc: DataFrame, hours: int = 48, sources: int = 3) -> DataFrame:
    """Windows of 48 hours from a payment in which three or more accounts, a seed among
    them, pay the same destination.

    A payment counts for every window that begins in the 48 hours up to it; its account
    counts once, by its first payment of a window: one for which the account's payment
    before lies ahead of the window."""
    span = hours * HOUR
    width = STRETCH * span
    out = with_destination(tx.where("direction = 'DR'")).where("dest is not null").withColumn("sec", seconds("transaction_date"))
    out = out.join(acc.select("account_id", F.col("is_seed").alias("seed")), "account_id", "left")
    before = F.lag("sec").over(Window.partitionBy("dest", "account_id").orderBy("sec"))
    seed = F.when(F.coalesce("seed", F.lit(False)), 1).otherwise(0)
    rows = out.select("dest", "transaction_date", "sec", "amount", seed.alias("seeds"), before.alias("before"))
    none = F.lit(0).cast("decimal(18,2)")
    cell = F.floor(F.col("sec") / width)
    since = F.col("sec") - span
    first = F.greatest(F.coalesce(F.col("before") + 1, since), since)  # no window before this one counts the account for this row
    step = lambda at, transfers, amount, seeds, accounts: F.struct(at.alias("at"), F.lit(transfers).alias("transfers"), amount.alias("amount"), seeds.alias("seeds"), accounts.alias("accounts"))
    new = F.when(first <= F.col("sec"), 1).otherwise(0)
    steps = F.array(step(since, 1, F.col("amount"), F.col("seeds"), F.lit(0)), step(first, 0, none, F.lit(0), new), step(F.col("sec") + 1, -1, -F.col("amount"), -F.col("seeds"), -new))
    # in both stretches that the windows can begin in; what began before one is there at its edge
    edge = F.col("cell") * width
    moves = rows.withColumn("cell", F.explode(F.array_distinct(F.array(cell, F.floor(since / width))))).select("dest", "cell", "transaction_date", F.explode(steps).alias("s")).select("dest", "cell", "transaction_date", "s.*")
    moves = moves.withColumn("at", F.greatest(F.col("at"), edge)).where(F.floor(F.col("at") / width) == F.col("cell")).withColumn("own", F.lit(False))
    asked = rows.select("dest", cell.alias("cell"), "transaction_date", F.col("sec").alias("at"), F.lit(0).alias("transfers"), none.alias("amount"), F.lit(0).alias("seeds"), F.lit(0).alias("accounts"), F.lit(True).alias("own"))
    got = running(moves.unionByName(asked), ["dest", "cell"], ["transfers", "amount", "seeds", "accounts"])
    got = got.where((F.col("seeds") > 0) & (F.col("accounts") >= sources))
    return got.select("dest", F.col("transaction_date").alias("window_start"), F.col("accounts").cast("int").alias("sources"), "transfers", F.col("amount").cast("double").alias("amount")).distinct()


def calls(tel: DataFrame, ent: DataFrame) -> DataFrame:
    """Call records with the caller's entity."""
    cdr = tel.where("event_type = 'CDR'").select("event_id", "msisdn", F.col("event_at").alias("call_at"), "b_party", "call_type", "duration_sec")
    return cdr.join(ent.select("entity_id", F.col("phone").alias("msisdn")), "msisdn", "left")


def call_before_transfer(ev, minutes: int = 15) -> DataFrame:
    """Transfers with calls of the same entity in the minutes before them, up to but not
    at the moment of the transfer."""
    said = calls(ev.tel, ev.ent).where("entity_id is not null and b_party <> ''").select("entity_id", "event_id", "call_at")
    pay = owned(ev.tx, ev.acc).select("entity_id", "transaction_id", "account_id", "transaction_date", F.col("amount").cast("double").alias("amount"))
    met = interval_join(pay, said, ["entity_id"], "transaction_date", "call_at", -minutes * 60, 0).where(F.col("call_at") < F.col("transaction_date"))
    return met.groupBy("entity_id", "transaction_id", "account_id", "transaction_date", "amount").agg(F.count(F.lit(1)).alias("calls"), F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("call_ids"))


def largest_near(points: DataFrame, pay: DataFrame, reach: int) -> DataFrame:
    """``at, best``: for each moment of ``points`` (at) the largest transfer of ``pay``
    (at, amount, transaction_id and others) within ``reach`` seconds. Whole minutes are
    asked for their largest one, the two at the ends for their seconds', so that a
    moment meets some two hundred rows at most, however many transfers there are."""
    order = F.struct("amount", "transaction_id")
    per_second = pay.groupBy("at").agg(F.max_by(F.struct(*[c for c in pay.columns if c != "at"]), order).alias("best"))
    per_second = per_second.withColumn("minute", F.floor(F.col("at") / 60))
    by_best = F.struct("best.amount", "best.transaction_id")
    per_minute = per_second.groupBy("minute").agg(F.max_by("best", by_best).alias("best"))
    low, high = F.col("at") - reach, F.col("at") + reach
    asked = points.select("at").distinct().select("at", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.floor(low / 60), F.floor(high / 60))).alias("minute"))
    whole = (F.col("minute") * 60 >= F.col("low")) & (F.col("minute") * 60 + 59 <= F.col("high"))
    inner = asked.where(whole).join(per_minute, "minute").select("at", "best")
    ends = asked.where(~whole).join(per_second.withColumnRenamed("at", "second"), "minute").where("second between low and high").select("at", "best")
    return inner.unionByName(ends).groupBy("at").agg(F.max_by("best", by_best).alias("best"))


def call_transfer_correlation(ev, minutes: int = 10) -> DataFrame:
    """For each call its best transfer: of the caller's entity within ten minutes, the
    largest amount; else the largest of the same day. A caller without an entity is
    matched with any account's transfers within ten minutes. A transfer with a date
    alone is scored by the clock in its texts, where they have one."""
    said = calls(ev.tel, ev.ent)
    pay = owned(ev.tx, ev.acc).select("entity_id", "transaction_id", "transaction_date", F.col("amount").cast("double").alias("amount"), X.clock_text(ev.tx.columns).alias("narration"))
    fields = F.struct("transaction_id", "transaction_date", "amount", "narration")
    order = F.struct("amount", "transaction_id")
    known = said.where("entity_id is not null").select("entity_id", "event_id", "call_at")
    close = interval_join(known, pay, ["entity_id"], "call_at", "transaction_date", -minutes * 60, minutes * 60)
    close = close.groupBy("entity_id", "event_id", "call_at").agg(F.max_by(fields, order).alias("b")).withColumn("tier", F.lit(1))
    # one row for each entity and day, whatever happened on it, for the calls that are left
    daily = pay.groupBy("entity_id", F.to_date("transaction_date").alias("day")).agg(F.max_by(fields, order).alias("b"))
    left = known.join(close.select("event_id"), "event_id", "left_anti").withColumn("day", F.to_date("call_at"))
    day = left.join(daily, ["entity_id", "day"]).drop("day").withColumn("tier", F.lit(2))
    strange = said.where("entity_id is null").select("event_id", "call_at", seconds("call_at").alias("at"))
    near = largest_near(strange, pay.withColumn("at", seconds("transaction_date")), minutes * 60)
    loose = strange.join(near, "at").select(F.col("best.entity_id").alias("entity_id"), "event_id", "call_at", F.struct("best.transaction_id", "best.transaction_date", "best.amount", "best.narration").alias("b"), F.lit(1).alias("tier"))
    best = close.unionByName(day).unionByName(loose)
    best = best.select("event_id", "call_at", "entity_id", "b.transaction_id", "b.transaction_date", "b.amount", "tier", "b.narration")
    clock = X.has_clock(F.col("transaction_date"))
    said = X.clock_from_text(F.col("narration"), F.col("transaction_date"))
    best = best.withColumn("paid", F.when(clock, F.col("transaction_date").cast("timestamp")).otherwise(said.cast("timestamp")))
    delta = F.abs(F.unix_timestamp("paid") - seconds("call_at"))
    exact = F.col("paid").isNotNull()
    score = F.when(exact, F.greatest(F.lit(40.0), F.least(F.lit(98.0), 100 - delta / 10))).otherwise(74.0)
    source = F.when(clock, "statement").when(exact, "narration").otherwise("linked_cdr")
    return best.withColumn("delta_sec", F.when(exact, delta).otherwise(0)).withColumn("time_source", source).withColumn("score", score).drop("narration", "paid")


def nearest_in_time(points: DataFrame, sites: DataFrame, keys: list[str], reach: Column | int) -> DataFrame:
    """``keys, at, gap_sec, site``: for each moment of ``points`` (keys, at) the site of
    ``sites`` (keys, at, site: a struct that begins with its id) nearest in time, within
    ``reach`` seconds, a number or one of the keys; of two as near the one with the
    smaller id.

    Of a key's sites in one second only the first counts, so a stretch of time holds as
    many rows as seconds at most; each is sorted once forwards and once backwards."""
    width = STRETCH * reach
    first = sites.groupBy(*keys, "at").agg(F.min("site").alias("site"))
    cells = F.array_distinct(F.transform(F.array(F.col("at") - reach, F.col("at"), F.col("at") + reach), lambda x: F.floor(x / width)))
    both = first.withColumn("cell", F.explode(cells)).withColumn("own", F.lit(False))
    asked = points.select(*keys, "at").distinct().withColumn("cell", F.floor(F.col("at") / width)).withColumn("own", F.lit(True))
    both = both.unionByName(asked, allowMissingColumns=True).withColumn("seen", F.when(F.col("site").isNotNull(), F.struct("at", "site")))
    frame = lambda order: Window.partitionBy(*keys, "cell").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # asked moments and sites of one second are peers of a range; an array of one tells them from nothing
    side = lambda order: F.max_by("seen", F.when(F.col("seen").isNotNull(), order)).over(frame(order))
    both = both.withColumn("earlier", side(F.col("at"))).withColumn("later", side(-F.col("at"))).where("own")
    pick = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col("at")).alias("gap_sec"), F.col(f"{c}.site").alias("site")))
    return both.withColumn("b", F.least(pick("earlier"), pick("later"))).select(*keys, "at", "b.*").where(F.col("gap_sec") <= reach)


def nearest_session(ev, near: int = 2, far: int = 6, correlated: DataFrame | None = None) -> DataFrame:
    """For each correlated call the internet session beside it: within two hours of the
    same phone or of none, else within six hours of anyone; the nearest first."""
    found = (call_transfer_correlation(ev) if correlated is None else correlated).select("event_id", seconds("call_at").alias("at"))
    phones = ev.tel.where("event_type = 'CDR'").select("event_id", F.col("msisdn").alias("phone"))
    found = found.join(phones, "event_id")
    net = ev.tel.where("event_type = 'IPDR'").select(F.col("msisdn").alias("phone"), seconds("event_at").alias("at"), F.struct(F.col("event_id").alias("session_id"), "ip_address").alias("site"))
    # every session counts for anyone, and for its phone or as one without; a group and its reach are one key, so all are sorted together
    group = lambda name, hours: F.struct(name.alias("whose"), F.lit(hours * HOUR).alias("reach"))
    own, blank, anyone = F.concat(F.lit("="), "phone"), F.lit("blank"), F.lit("anyone")
    asked = found.select("event_id", "at", F.explode(F.array(group(own, near), group(blank, near), group(anyone, far))).alias("g")).select("event_id", "at", "g.*")
    site = net.select("at", "site", F.explode(F.array(group(F.when(F.col("phone") != "", own).otherwise(blank), near), group(anyone, far))).alias("g")).select("at", "site", "g.*")
    keys = ["whose", "reach"]
    beside = asked.join(nearest_in_time(asked, site, keys, F.col("reach")), [*keys, "at"])
    tier = F.when(F.col("whose") == anyone, 2).otherwise(1)
    met = beside.groupBy("event_id").agg(F.min(F.struct(tier.alias("tier"), "gap_sec", "site")).alias("b"))
    return met.select("event_id", "b.site.session_id", "b.site.ip_address", "b.gap_sec", "b.tier")
