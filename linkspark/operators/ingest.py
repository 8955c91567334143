"""Keeping tables: upsert, insert-missing, merges, purge, lineage and profiles.

Order columns break every tie, so that a run over the same rows gives the same table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import name_best, number_matches


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last by ``order``: a maximum, combined before the
    shuffle, so that one hot key does not meet in a task."""
    # no column twice in what is sorted and shuffled
    value = list(dict.fromkeys(c for c in [*order, *rows.columns] if c not in keys))
    best = rows.groupBy(*keys).agg(F.max(F.struct(*value)).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Whole rows replaced by key; among the new ones the last wins."""
    tag = lambda df, n: df.withColumn("_load", F.lit(n))
    both = tag(existing, 0).unionByName(tag(new, 1), allowMissingColumns=True)
    return latest(both, keys, ["_load", *order]).drop("_load")


def insert_missing(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What ``new`` adds: its first row of each key that does not exist yet."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_best")).select(*keys, "_best._row.*")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def merge_entities(rows: DataFrame) -> DataFrame:
    """Entities that came in several loads (``seq``): a seed if any is, the last name
    and PAN that are not blank, all phones, the last form of each account."""
    last = lambda c: F.max_by(F.nullif(F.trim(c), F.lit("")), F.when(F.trim(c) != "", F.col("seq"))).alias(c)
    phones = rows.select("entity_id", F.explode_outer("phones").alias("p")).groupBy("entity_id").agg(F.array_sort(F.collect_set("p")).alias("phones"))
    acc = rows.select("entity_id", "seq", F.explode("accounts").alias("a")).groupBy("entity_id", "a.account_id").agg(F.max_by("a", "seq").alias("a")).groupBy("entity_id").agg(F.array_sort(F.collect_list("a")).alias("accounts"))
    base = rows.groupBy("entity_id").agg(F.bool_or("is_seed").alias("is_seed"), last("entity_name"), last("pan"))
    return base.join(phones, "entity_id", "left").join(acc, "entity_id", "left")


def merge_duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first one's fields, its blanks filled by the next."""
    fields = [c for c in rows.columns if c not in (key, order)]
    filled = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return rows.groupBy(key).agg(*filled, F.count(F.lit(1)).alias("copies")).withColumn("dup_status", F.when(F.col("copies") > 1, "merged").otherwise("unique"))


def purge(facts: DataFrame, linked: DataFrame, keys: list[str]) -> DataFrame:
    """Facts without those that a deleted document brought."""
    return facts.join(linked.select(*keys).distinct(), keys, "left_anti")


def already_loaded(existing: DataFrame, new: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """Keys of which so many rows exist that a file need not be loaded again."""
    have = existing.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    come = new.groupBy(key).agg(F.count(F.lit(1)).alias("come"))
    return come.join(have, key, "left").na.fill(0, ["have"]).withColumn("skip", F.col("have") >= share * F.col("come"))


def load_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows")) for n, df in tables.items()])


def lineage(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """For each source file: rows, distinct accounts, and how many rows are new."""
    marked = rows.join(known.select(*keys).distinct().withColumn("_known", F.lit(True)), keys, "left")
    return marked.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("account_id").alias("accounts"), F.count_if(F.col("_known").isNull()).alias("added"))


def profile(tx: DataFrame) -> DataFrame:
    """How often counterparty fields are filled."""
    filled = lambda c: (F.count_if(F.trim(c) != "") / F.count(F.lit(1))).alias(c)
    return tx.agg(F.count(F.lit(1)).alias("rows"), filled("counterparty_account"), filled("counterparty_name"), filled("mode"))


# Labels before an account number.
ACCOUNT_LABEL = r"(?i)(?:A/?C\s*(?:No|Number|Num)?\.?\s*[:\-]?\s*|Account\s*No\.?\s*[:\-]?\s*|Acct\s*Range\s*:\s*|Account\s*Number\s*[:\-]?\s*)(\d{9,18})"


def account_candidates(hints: DataFrame) -> DataFrame:
    """``doc, run``: the digit runs of a document's ``text`` that may be its account: after
    a label, or nine to eighteen digits alone; and those of its file's ``name``, if the
    frame has one: nine to eighteen digits, or five to eight that are all of the stem."""
    labelled = F.regexp_extract_all("text", F.lit(ACCOUNT_LABEL), F.lit(1))
    alone = F.regexp_extract_all("text", F.lit(r"\b(\d{9,18})\b"), F.lit(1))
    stem = F.regexp_replace(F.coalesce("name", F.lit("")), r"(?<=.)\.[^.]*$", "") if "name" in hints.columns else None
    named = [] if stem is None else [F.regexp_extract_all(stem, F.lit(r"(\d{9,18})"), F.lit(1)), F.regexp_extract_all(stem, F.lit(r"^\s*(\d{5,8})\s*$"), F.lit(1))]
    return hints.select("doc", F.explode(F.array_distinct(F.concat(labelled, alone, *named))).alias("run"))


def account_matches(hints: DataFrame, accounts: DataFrame, least: int = 5) -> DataFrame:
    """``doc, account_id``: accounts whose number holds a digit run of the document, or
    whose last twelve digits end the run."""
    numbers = accounts.select(F.col("account_id").alias("id"), F.col("account_number").alias("number"))
    return number_matches(account_candidates(hints), numbers, least).withColumnRenamed("id", "account_id")


# Words of file names that name no one.
NAME_STOP = ("document", "statement", "bank", "account", "new", "scan", "copy", "file", "nov", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "dec")


def name_matches(files: DataFrame, names: DataFrame, stop: tuple[str, ...] = NAME_STOP) -> DataFrame:
    """``doc, entity_id, hits``: the entity whose id and name hold most of the words of
    four letters and more in the file's name."""
    words = F.array_distinct(F.filter(F.split(F.lower("name"), "[^a-z]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*stop)))
    text = F.lower(F.concat_ws(" ", "entity_id", "entity_name"))
    found = name_best(files.select("doc", words.alias("words")), names.select(F.col("entity_id").alias("id"), text.alias("text")))
    return found.select("doc", F.col("id").alias("entity_id"), F.col("hits").cast("long"))


def append_audit(path: str, entries: DataFrame) -> None:
    entries.write.mode("append").parquet(path)


def audit(entries: DataFrame, case_id: str | None = None, k: int = 20) -> DataFrame:
    """The newest entries."""
    kept = entries if case_id is None else entries.where(F.col("case_id") == case_id)
    return kept.orderBy(F.desc("timestamp"), "action").limit(k)


