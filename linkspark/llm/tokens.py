"""Token counts in delta-maintained rollups.

A rollup is a table of additive totals (documents, tokens, characters) by source,
language and tokenizer version. Batches bring changes: ``op`` insert, delete or
revise of a document's text. Each change becomes signed rows, new text +1 and old
text -1, which are summed before they are shuffled. A commit writes its sums into a
folder of its own and then names it in the manifest, for each tokenizer and batch, so
that a commit that breaks off counts nothing and one that is sent again replaces its
batch and counts once; another tokenizer's sums of that batch are not touched.

The totals are kept as snapshots. A snapshot lists the commits that it holds; totals
are its rows, plus the sums of commits that have come since, less those of commits
that have been replaced since: no others are read again.

Defined cases: a null text counts as empty, 0 tokens; null sources and languages are
groups; repeated rows are documents of their own; changes whose op is null or unknown
change nothing; a batch that is named without rows has no sums any more; an empty
commit that names no batch changes nothing, and a rollup without commits has no rows;
groups whose documents are all deleted again leave the totals; other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

import base64
import time
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, new_path, text_of

ROWS = 256
MEASURES = ("documents", "tokens", "characters")
GROUPS = ("source", "lang", "tokenizer")


class TokenCounter:
    """Counts a byte-level vocabulary's tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encoding.encode_ordinary_batch(texts, num_threads=1)]


@lru_cache(maxsize=2)
def _counter(ranks: bytes, pattern: str) -> TokenCounter:
    return TokenCounter(ranks, pattern)


def counted(docs: DataFrame, ranks_path: str, pattern: str, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``tokens``, ``characters`` of each row's text."""
    with open(ranks_path, "rb") as f:  # a vocabulary's size is fixed: under a megabyte
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    only = docs.select(F.struct(*[F.col(f"`{c}`") for c in keys]).alias("k"), text_of(docs, text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counter.count(texts), pa.int64()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "tokens", "characters"])

    return map_batches(only, run, f"k {only.schema['k'].dataType.simpleString()}, tokens long, characters long").select("k.*", "tokens", "characters")


def signed_changes(changes: DataFrame, *keys: str) -> DataFrame:
    """Rows ``source, lang, text, sign`` from changes ``op, source, lang, text,
    old_source, old_lang, old_text``, after columns ``keys``: insert has the new ones,
    delete the old ones, revise both, any other op none."""
    new = F.struct("source", "lang", "text", F.lit(1).alias("sign"))
    old = F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_text").alias("text"), F.lit(-1).alias("sign"))
    rows = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(old)).when(F.col("op") == "revise", F.array(new, old))
    return changes.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


class Rollup:
    """A rollup at ``path``, a folder that all executors share."""

    SUMS = "source string, lang string, documents long, tokens long, characters long, tokenizer string, batch string, commit string"
    MANIFEST = "tokenizer string, batch string, commit string, at long"
    TOTALS = "source string, lang string, tokenizer string, documents long, tokens long, characters long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, part: str, schema: str) -> DataFrame:
        """A part of the rollup; no rows before the first commit."""
        at = f"{self.path}/{part}"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(at)

    def commit(self, signed: DataFrame, tokenizer: str, ranks_path: str, pattern: str, batches: list[str] | None = None) -> None:
        """Put signed rows ``batch, source, lang, text, sign`` in the place of all that
        their batches held for this tokenizer. ``batches``: names to replace even if no
        row has them."""
        n = counted(signed, ranks_path, pattern, ["batch", "source", "lang", "sign"])
        sums = n.groupBy("source", "lang", F.lit(tokenizer).alias("tokenizer"), "batch").agg(
            F.sum("sign").cast("long").alias("documents"),
            F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"),
            F.sum(F.col("sign") * F.col("characters")).cast("long").alias("characters"),
        )
        name = uuid.uuid4().hex
        sums.withColumn("commit", F.lit(name)).write.mode("append").partitionBy("tokenizer", "batch", "commit").parquet(f"{self.path}/sums")
        written = self._read("sums", self.SUMS).where((F.col("tokenizer") == tokenizer) & (F.col("commit") == name)).select("tokenizer", "batch").distinct()
        if batches:
            given = self.spark.createDataFrame([(tokenizer, b) for b in batches], "tokenizer string, batch string")
            written = written.union(given).distinct()
        entries = written.withColumn("commit", F.lit(name)).withColumn("at", F.lit(time.time_ns()))
        entries.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _current(self) -> DataFrame:
        """The last commit of each tokenizer and batch."""
        last = F.max(F.struct("at", "commit")).alias("last")
        return self._read("manifest", self.MANIFEST).groupBy("tokenizer", "batch").agg(last).select("tokenizer", "batch", "last.commit")

    def _snapshot(self) -> tuple[DataFrame, DataFrame]:
        """The rows of the newest snapshot and the commits that it holds."""
        newest = self._read("snapshots", "name string, at long").agg(F.max_by("name", "at")).first()[0]
        if newest is None:
            return self.spark.createDataFrame([], self.TOTALS), self.spark.createDataFrame([], "tokenizer string, batch string, commit string")
        return self._read(f"totals/{newest}", self.TOTALS), self._read(f"held/{newest}", "tokenizer string, batch string, commit string")

    def _summed(self) -> tuple[DataFrame, DataFrame]:
        """The totals, and the commits they hold."""
        base, held = self._snapshot()
        current, keys = self._current(), ["tokenizer", "batch", "commit"]
        changed = current.join(held, keys, "left_anti").withColumn("times", F.lit(1)).unionByName(held.join(current, keys, "left_anti").withColumn("times", F.lit(-1)))
        deltas = self._read("sums", self.SUMS).join(changed, keys)
        rows = base.unionByName(deltas.select("source", "lang", "tokenizer", *[(F.col(m) * F.col("times")).alias(m) for m in MEASURES]))
        total = rows.groupBy(*GROUPS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])
        return total.where(" or ".join(f"{m} <> 0" for m in MEASURES)), current

    def refresh(self) -> None:
        """Keep the totals of now as a snapshot: its rows, its commits, then its name,
        so that one that breaks off is never read."""
        name = uuid.uuid4().hex
        total, current = self._summed()
        current = cut(current)  # a row per batch, the same for both tables
        total.write.parquet(f"{self.path}/totals/{name}")
        current.write.parquet(f"{self.path}/held/{name}")
        self.spark.createDataFrame([(name, time.time_ns())], "name string, at long").coalesce(1).write.mode("append").parquet(f"{self.path}/snapshots")

    def totals(self) -> DataFrame:
        """The totals over all committed batches."""
        return self._summed()[0]


def history(docs: DataFrame, batches: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows of two commits whose totals are those of ``docs``: first every
    document arrives, in batches by the crc of its id, some in a first half that is
    revised later and some with a draft that is deleted later; then those changes."""
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0))
    text = text_of(docs)
    rows = docs.select(crc.alias("crc"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    early, draft = F.col("crc") % 8 == 5, F.col("crc") % 8 == 3
    half = F.left("text", (F.length("text") / 2).cast("int"))
    one = lambda t, sign: F.struct(t.alias("text"), F.lit(sign).alias("sign"))
    first = F.when(early, F.array(one(half, 1))).when(draft, F.array(one(F.col("text"), 1), one(half, 1))).otherwise(F.array(one(F.col("text"), 1)))
    name = lambda kind: F.concat(F.lit(kind), (F.col("crc") % batches).cast("string")).alias("batch")
    arrived = rows.select(name("b"), "source", "lang", F.explode(first).alias("r")).select("batch", "source", "lang", "r.*")
    op = F.when(early, "revise").when(draft, "delete")
    changes = rows.where(early | draft).select(name("c"), op.alias("op"), "source", "lang", "text", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), half.alias("old_text"))
    return arrived, signed_changes(changes, "batch")


def op9_token_counts(spark, sf_dir: str, batches: int = 4) -> DataFrame:
    """Totals of all documents, after inserts, revisions, deletes and a batch that is
    sent twice."""
    import public_tokenizers as vocabulary

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rollup = Rollup(spark, new_path(spark, "token-rollup"))
    how = "byte_bpe_50k", vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN
    arrived, changes = history(docs, batches)
    rollup.commit(arrived, *how)
    rollup.refresh()
    rollup.commit(changes, *how)
    rollup.commit(arrived.where("batch = 'b1'"), *how)
    return rollup.totals()
