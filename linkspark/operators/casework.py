"""Cases: the active one, its seeds and documents, summaries, and texts for display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import aggregates as A
from . import graph as G
from . import patterns as P
from . import scoring as S
from . import timeline as T

# What stands for a case where there is none.
NO_CASE = {"case_id": "FIR-UNASSIGNED", "status": "open"}


def active_case(cases: DataFrame) -> DataFrame:
    """``case_id, status``, one row: the active case, else the first one, else none."""
    one = cases.agg(F.min(F.struct((F.col("status") != "active").alias("rest"), "case_id", "status")).alias("c"))
    return one.select(*[F.coalesce(F.col(f"c.{k}"), F.lit(v)).alias(k) for k, v in NO_CASE.items()])


def seed_set(ent: DataFrame, k: int = 10) -> DataFrame:
    """The seeds, or, where there is none, the first k entities by id."""
    n = ent.agg(F.count_if("is_seed").alias("_seeds"))
    first = ent.orderBy("entity_id").limit(k).crossJoin(n).where("_seeds = 0").drop("_seeds")  # k rows and one
    return ent.where("is_seed").unionByName(first)


def phone_map(ent: DataFrame) -> DataFrame:
    """``phone, entity_id, entity_name, is_seed``: each normalised phone's last entity."""
    rows = ent.select(F.explode("phones").alias("p"), "entity_id", "entity_name", "is_seed").withColumn("phone", X.norm_phone(F.col("p"))).where("phone <> ''")
    last = F.max_by(F.struct("entity_id", "entity_name", "is_seed"), "entity_id").alias("e")
    return rows.groupBy("phone").agg(last).select("phone", "e.*")


def case_documents(docs: DataFrame, cases: DataFrame, case_id: str | None = None, k: int = 300) -> DataFrame:
    """The k newest documents of a case, by default of the active one."""
    if case_id is not None:
        own = docs.where(F.col("case_id") == case_id)
    else:
        own = docs.join(F.broadcast(active_case(cases).select("case_id")), "case_id")
    return own.orderBy(F.desc("uploaded_at"), "doc_id").limit(k)


def command_centre(ev, k: int = 50) -> DataFrame:
    """The case's figures in one row; leads are counted among the k highest scores."""
    seeds = seed_set(ev.ent).agg(F.count(F.lit(1)).alias("seeds"))
    totals = A.overview(ev).select("entities", "transactions", "cdr", "ipdr", F.col("credit_total").alias("money_traced"))
    leads = S.leaderboard(S.profiles(ev), k).agg(F.count_if(F.col("category").isin("CRITICAL", "HIGH")).alias("priority_leads"))
    one = totals.crossJoin(seeds).crossJoin(leads)  # one row each
    return one.withColumn("total_events", F.col("transactions") + F.col("cdr") + F.col("ipdr")).withColumn("money_shown", X.rupees(F.col("money_traced")))


def timeline_counts(ev, k: int = 200) -> DataFrame:
    """For each entity how many of its k latest events each source has."""
    n = lambda s: F.count_if(F.col("source") == s).alias(s.lower())
    return T.entity_timeline(ev, k).groupBy("entity_id").agg(n("BANK"), n("CDR"), n("IPDR"), F.count(F.lit(1)).alias("total"))


def stack_summary(ev) -> DataFrame:
    """``name, n``: flags of the detectors, sizes of graph and tables."""
    parts = {
        "rapid_layering": P.rapid_layering(ev.tx),
        "convergence_48h": P.convergence(ev.tx, ev.acc),
        "call_before_transfer": P.call_before_transfer(ev),
        "graph_nodes": G.nodes(ev),
        "graph_edges": G.edges(ev),
        "entities": ev.ent,
        "transactions": ev.tx,
        "telecom": ev.tel,
    }
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in parts.items()])


def flagged_layering(rows: DataFrame) -> DataFrame:
    """``id, title, detail`` of flagged ledger rows."""
    detail = F.concat(F.lit("Outgoing/Ingoing ratio: "), X.two_places(F.col("ratio")), F.lit(" | Credit ₹"), X.two_places(F.col("credit")), F.lit(" | Debit ₹"), X.two_places(F.col("debit")))
    return rows.select(F.col("transaction_id").alias("id"), F.concat(F.lit("Transaction "), "transaction_id").alias("title"), detail.alias("detail"))


def flagged_hubs(rows: DataFrame) -> DataFrame:
    detail = F.format_string("%d sources | %d tx | ₹%.2f", "sources", "transfers", "amount")
    return rows.select(F.col("dest").alias("id"), F.concat(F.lit("Hub: "), "dest").alias("title"), detail.alias("detail"))


def flagged_calls(rows: DataFrame) -> DataFrame:
    detail = F.format_string("%d matching calls | Amount ₹%.2f", "calls", "amount")
    return rows.select(F.col("transaction_id").alias("id"), F.concat(F.lit("Call → Transfer: "), "transaction_id").alias("title"), detail.alias("detail"))


def narrative(profiles: DataFrame) -> DataFrame:
    """``entity_id, narrative``: a profile in a sentence, and what fired."""
    fired = F.transform(F.filter("table", lambda x: x["points"] > 0), lambda x: x["evidence"])
    span = F.when(F.col("span").isNotNull(), F.format_string(", %dd span", "span")).otherwise("")
    named = F.coalesce(X.blank(F.col("entity_name")), F.col("entity_id"))
    share = F.concat(F.bround(F.col("ratio") * 100, 0).cast("long").cast("string"), F.lit("% pass-through, "))
    text = F.concat(
        named, F.lit(": "), "role", F.lit(". In "), X.rupees(F.col("inflow")), F.lit(" / out "), X.rupees(F.col("outflow")), F.lit(" ("), share, F.col("tx_count").cast("string"), F.lit(" txns"), span,
        F.lit("). Indicators: "), F.coalesce(X.blank(F.array_join(fired, ", ")), F.lit("none")), F.lit(". Confidence "), F.floor(F.col("confidence") * 100).cast("string"), F.lit("%."),
    )
    return profiles.select("entity_id", text.alias("narrative"))


def safe_name(name: Column) -> Column:
    """A file name without folders and without characters that file systems mind."""
    return F.left(F.regexp_replace(F.substring_index(name, "/", -1), r"[^A-Za-z0-9._\- ]+", "_"), F.lit(180))
