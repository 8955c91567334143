"""Risk scores relative to the case: features, roles, indicators, rescale, category.

All entities are scored at once. Features are two hash aggregations; percentile ranks
are range sums over buckets of value; every rule is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import aggregates as A
from .order import shares

MIN_TX, MIN_INFLOW = 3, 25_000.0
TABLE = "array<struct<evidence:string,bucket:string,points:int>>"


def pct_ranks(values: DataFrame, norms: DataFrame) -> DataFrame:
    """``key, measure, rank``: the share of the norms not above each (key, measure,
    value); values of 0 rank 0."""
    above = values.where("value > 0")
    ranked = above.join(shares(above, norms), ["measure", "value"]).select("key", "measure", F.col("share").alias("rank"))
    return values.select("key", "measure").join(ranked, ["key", "measure"], "left").select("key", "measure", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def features(ev) -> DataFrame:
    """One row for each entity, those without a ledger included."""
    tel, totals = A.telecom_stats(ev.tel), A.account_totals(ev.tx)
    base = ev.ent.select("entity_id", "entity_name", "is_seed", "phone").join(A.entity_stats(ev.tx, ev.acc, totals), "entity_id", "left")
    base = base.join(tel.select("phone", "cdr", "ipdr", F.col("first_at").alias("tel_first"), F.col("last_at").alias("tel_last")), "phone", "left")
    counts = ["tx_count", "in_count", "out_count", "in_parties", "out_parties", "round_count", "cdr", "ipdr"]
    base = base.na.fill(0, counts).na.fill(0.0, ["inflow", "outflow"])
    base = base.withColumn("span", F.when(F.col("first_at").isNotNull(), A.span_days(F.col("first_at"), F.col("last_at"))))
    base = base.withColumn("ratio", F.when(F.col("inflow") > 0, F.col("outflow") / F.col("inflow")).otherwise(0.0)).withColumn("per_day", F.coalesce(F.col("tx_count") / F.col("span"), F.lit(0.0)))
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("inflow", "outflow", "per_day")])
    values = base.select(F.col("entity_id").alias("key"), F.explode(pairs).alias("x")).select("key", "x.*")
    ranks = pct_ranks(values, A.norms(ev.tx, totals)).groupBy("key").agg(*[F.max(F.when(F.col("measure") == m, F.col("rank"))).alias(f"{m}_rank") for m in ("inflow", "outflow", "per_day")])
    return base.join(ranks, base["entity_id"] == ranks["key"]).drop("key")


def with_shape(f: DataFrame) -> DataFrame:
    """Operating book, the five flags of a mule's ledger, and the role."""
    c = F.col
    operating = (c("tx_count") >= 400) | F.coalesce((c("span") >= 45) & (c("tx_count") >= 80), F.lit(False))
    fan = ((c("in_parties") >= 3) & (c("out_parties") <= 2)) | ((c("out_parties") >= 3) & (c("in_parties") <= 2))
    flags = [
        F.coalesce((c("span") <= 21) & (c("tx_count") >= 4), F.lit(False)),
        c("tx_count").between(4, 150),
        fan,
        (c("tx_count") >= 6) & (c("round_count") / F.greatest(c("tx_count"), F.lit(1)) >= 0.5),
        c("is_seed") & (c("tx_count") <= 200),
    ]
    f = f.withColumns({"operating": operating, "fan": fan, "flags": sum((x.cast("int") for x in flags), F.lit(0))}).withColumn("shape_ok", c("flags") >= 2)
    both = (c("in_count") >= 2) & (c("out_count") >= 2)
    paid = both & (c("inflow") >= MIN_INFLOW)
    role = (
        F.when((c("in_count") == 0) & (c("out_count") == 0), "NO LEDGER")
        .when(c("operating") & both, "OPERATING ACCOUNT")
        .when(c("in_count") == 0, "SOURCE (ORIGINATOR)")
        .when(c("out_count") == 0, "SINK (TERMINAL)")
        .when(paid & c("ratio").between(0.85, 1.12) & c("shape_ok"), "INTERMEDIARY MULE")
        .when(c("fan") & (c("in_parties") >= 4) & (c("out_parties") <= 2) & ~c("operating"), "FUNNEL / COLLECTOR")
        .when(c("fan") & (c("out_parties") >= 4) & (c("in_parties") <= 2) & ~c("operating"), "DISTRIBUTOR")
        .when(paid & (c("ratio") >= 0.7) & c("shape_ok"), "LAYERED FORWARDER")
        .otherwise("STANDARD PARTICIPANT")
    )
    return f.withColumn("role", role)


def above(rank: Column, most: int, floor: float) -> Column:
    return F.when(rank < floor, 0).otherwise(F.bround(F.lit(float(most)) * (rank - floor) / (1.0 - floor), 0).cast("int"))


def with_indicators(f: DataFrame) -> DataFrame:
    """``pass_points`` and ``found``: the indicators that fire, in their fixed order."""
    c = F.col
    free = ~c("operating")
    tight = 1.0 - F.least(F.lit(1.0), F.abs(1.0 - c("ratio")) / 0.4)
    passing = free & c("shape_ok") & (c("inflow") >= MIN_INFLOW) & (c("in_count") >= 2) & (c("out_count") >= 2) & (c("ratio") >= 0.6) & (tight > 0)
    f = f.withColumn("pass_points", F.when(passing, F.bround(24 * tight, 0).cast("int")).otherwise(0))
    quick = (c("pass_points") >= 10) & c("span").isNotNull()
    drain = quick & (c("span") <= 3) & (c("tx_count") >= 4)
    fans = free & c("tx_count").between(MIN_TX, 200) & (c("inflow") >= MIN_INFLOW)
    few = lambda a, n, b, m: fans & (c(a) >= n) & (c(b) <= m)
    sink = (c("out_count") == 0) & (c("in_count") >= MIN_TX) & (c("inflow_rank") >= 0.75)
    origin = (c("in_count") == 0) & (c("out_count") >= MIN_TX) & (c("outflow_rank") >= 0.75)
    volume = above(F.greatest("inflow_rank", "outflow_rank"), 16, 0.62)
    volume = F.when(c("operating"), F.least(volume, F.lit(6))).when(~c("shape_ok"), F.least(volume, F.lit(8))).otherwise(volume)
    share = c("round_count") / c("tx_count")
    overlap = F.coalesce((c("first_at") <= c("tel_last")) & (c("tel_first") <= c("last_at")), F.lit(False))
    pair = free & (c("cdr") >= 8) & (c("ipdr") >= 3)
    heavy = free & ~pair & (c("ipdr") >= 8)
    row = lambda name, bucket, points: F.struct(F.lit(name).alias("evidence"), F.lit(bucket).alias("bucket"), points.cast("int").alias("points"))
    none = F.lit(0)
    rows = [
        row("Pass-through", "behavior", F.when(c("pass_points") >= 6, c("pass_points")).otherwise(none)),
        row("Rapid drain", "behavior", F.when(drain, 10).otherwise(none)),
        row("Short-window layering", "behavior", F.when(~drain & quick & (c("span") <= 7) & (c("tx_count") >= 6), 6).otherwise(none)),
        row("Fan-in collector", "behavior", F.when(few("in_parties", 5, "out_parties", 2), 12).when(few("in_parties", 3, "out_parties", 1), 8).otherwise(none)),
        row("Fan-out distributor", "behavior", F.when(few("in_parties", 5, "out_parties", 2) | few("in_parties", 3, "out_parties", 1), none).when(few("out_parties", 5, "in_parties", 2), 10).otherwise(none)),
        row("Terminal sink", "behavior", F.when(sink, 8).otherwise(none)),
        row("Originator", "behavior", F.when(~sink & origin, 6).otherwise(none)),
        row("Case-high volume", "transactions", volume),
        row("High velocity", "transactions", F.when(c("operating") | (c("per_day") == 0), none).otherwise(above(c("per_day_rank"), 10, 0.7))),
        row("Round-amount structuring", "transactions", F.when(free & c("tx_count").between(6, 200) & (share >= 0.55) & (c("round_count") >= 5), F.when(share >= 0.75, 8).otherwise(5)).otherwise(none)),
        row("CDR + IPDR both present", "communication", F.when(pair, F.when(overlap, 7).otherwise(5)).otherwise(none)),
        row("Telecom window overlaps ledger", "communication", F.when(pair & overlap, 5).otherwise(none)),
        row("Heavy IPDR", "communication", F.when(heavy, F.when(overlap, 6).otherwise(4)).otherwise(none)),
        row("Heavy CDR", "communication", F.when(free & ~pair & ~heavy & overlap & (c("cdr") >= 40), 4).otherwise(none)),
    ]
    f = f.withColumn("found", F.filter(F.array(*rows), lambda x: x["points"] > 0))
    f = f.withColumn("behaving", points(c("found")))
    seed = F.when(c("behaving") >= 12, F.struct(F.lit("FIR-named party + independent indicators").alias("evidence"), F.lit("case_link").alias("bucket"), F.lit(8).alias("points"))).when(c("tx_count") >= MIN_TX, F.struct(F.lit("FIR-named party").alias("evidence"), F.lit("case_link").alias("bucket"), F.lit(4).alias("points"))).otherwise(F.struct(F.lit("FIR-named party").alias("evidence"), F.lit("identifiers").alias("bucket"), F.lit(3).alias("points")))
    return f.withColumn("found", F.when(c("is_seed"), F.concat("found", F.array(seed))).otherwise(c("found")))


def points(table: Column, bucket: str | None = None) -> Column:
    rows = table if bucket is None else F.filter(table, lambda x: x["bucket"] == bucket)
    return F.aggregate(rows, F.lit(0), lambda s, x: s + x["points"])


def rescaled(f: DataFrame) -> DataFrame:
    """``confidence``, ``table`` and ``total``: if the cap is below the sum, every row is
    scaled and rounded half to even, rows of 0 go, the drift lands on the first, and
    seed rows count as identifiers from then on."""
    c = F.col
    n = c("tx_count")
    known = (c("cdr") > 0) | (c("ipdr") > 0) | c("is_seed")
    f = f.withColumn("confidence", F.when(n >= 20, 0.95).when(n >= 8, 0.80).when(n >= MIN_TX, 0.62).when(n >= 1, 0.35).when(known, 0.15).otherwise(0.05))
    cap = F.when(n >= 20, 100).when(n >= 8, 92).when(n >= MIN_TX, 70).when(n >= 1, 40).when(c("is_seed"), 25).otherwise(12)
    f = f.withColumn("raw", points(c("found"))).withColumn("top", F.least(F.lit(100), c("raw"), cap))
    as_row = lambda x, p: F.struct(x["evidence"].alias("evidence"), F.when(x["evidence"].startswith("FIR-named"), "identifiers").otherwise(x["bucket"]).alias("bucket"), p.cast("int").alias("points"))
    scaled = F.filter(F.transform("found", lambda x: as_row(x, F.bround(x["points"] * (c("top") / c("raw")), 0))), lambda x: x["points"] > 0)
    f = f.withColumn("scaled", F.when((c("raw") > c("top")) & (c("top") > 0), scaled))
    drift = c("top") - points(c("scaled"))
    moved = F.transform("scaled", lambda x, i: as_row(x, F.when(i == 0, F.greatest(F.lit(0), x["points"] + drift)).otherwise(x["points"])))
    f = f.withColumn("table", F.coalesce(moved, c("found"))).withColumn("total", F.when(c("scaled").isNull(), c("top")).otherwise(points(F.coalesce(moved, c("found")))))
    return f.drop("scaled", "top")


def profiles(ev) -> DataFrame:
    """The risk profile of every entity."""
    return categorised(rescaled(with_indicators(with_shape(features(ev)))))


def categorised(f: DataFrame) -> DataFrame:
    c = F.col
    behavior = points(c("table"), "behavior")
    confirmed = ~c("operating") & c("shape_ok") & ((c("pass_points") >= 12) | (behavior >= 12))
    category = (
        F.when(confirmed & (c("total") >= 58) & (behavior >= 16) & c("tx_count").between(4, 250) & (c("confidence") >= 0.62), "CRITICAL")
        .when(confirmed & (c("total") >= 38) & (c("confidence") >= 0.62), "HIGH")
        .when(c("total") >= 28, "MEDIUM")
        .otherwise("LOW")
    )
    return f.withColumn("category", category).withColumns({f"{b}_points": points(c("table"), b) for b in ("case_link", "transactions", "behavior", "communication", "identifiers")})


def breakdown(p: DataFrame) -> DataFrame:
    """A row for each indicator; one of 0 points where none fired."""
    none = F.array(F.struct(F.lit("Insufficient pattern evidence").alias("evidence"), F.lit("none").alias("bucket"), F.lit(0).alias("points")))
    return p.select("entity_id", F.posexplode(F.when(F.size("table") == 0, none).otherwise(F.col("table"))).alias("position", "x")).select("entity_id", "position", "x.*")


def leaderboard(p: DataFrame, k: int | None = None) -> DataFrame:
    order = [F.desc("total"), F.desc("confidence"), F.desc("inflow"), "entity_id"]
    kept = p.select("entity_id", "entity_name", "is_seed", "role", "total", "category", "confidence", "tx_count", "inflow", "outflow", F.bround("ratio", 2).alias("ratio"), "cdr", "ipdr", *[f"{b}_points" for b in ("case_link", "transactions", "behavior", "communication", "identifiers")])
    return kept.orderBy(*order).limit(k) if k else kept
