"""Rollups of token counts against counts made directly."""

import collections

import pytest
from pyspark.sql import functions as F

from linkspark.llm import tokens

ROWS = "batch string, source string, lang string, text string, sign int"


@pytest.fixture(scope="module")
def how():
    import public_tokenizers as vocabulary

    return vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN


def totals(roll):
    return {(r["source"], r["tokenizer"]): (r["documents"], r["tokens"], r["characters"]) for r in roll.totals().collect()}


def test_tokenizers_and_empty_batches(spark, tmp_path, how):
    roll = tokens.Rollup(spark, str(tmp_path / "r"))
    assert roll.totals().count() == 0
    rows = spark.createDataFrame([("b0", "s", "en", "hello world", 1), ("b1", "s", "en", "hello", 1)], ROWS)
    roll.commit(rows, "t1", *how)
    roll.commit(rows, "t2", *how)
    assert totals(roll) == {("s", t): (2, 3, 16) for t in ("t1", "t2")}
    roll.refresh()
    assert totals(roll) == {("s", t): (2, 3, 16) for t in ("t1", "t2")}
    roll.commit(rows.limit(0), "t1", *how, batches=["b0"])  # the batch came again without rows
    roll.commit(rows.limit(0), "t2", *how)
    assert totals(roll) == {("s", "t1"): (1, 1, 5), ("s", "t2"): (2, 3, 16)}
    roll.refresh()
    roll.refresh()
    assert totals(roll) == {("s", "t1"): (1, 1, 5), ("s", "t2"): (2, 3, 16)}


def test_unknown_changes_count_nothing(spark):
    changes = spark.createDataFrame([("insert", "a"), (None, "b"), ("?", "c"), ("revise", "d")], "op string, text string")
    changes = changes.select("*", *[F.lit(None).cast("string").alias(c) for c in ("source", "lang", "old_source", "old_lang", "old_text")])
    assert sorted((r["text"] or "", r["sign"]) for r in tokens.signed_changes(changes).collect()) == [("", -1), ("a", 1), ("d", 1)]


def test_the_query_counts_every_document_once(spark, how):
    import base64

    import tiktoken

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    with open(how[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    library = tiktoken.Encoding("t", pat_str=how[1], mergeable_ranks=ranks, special_tokens={})
    want = collections.defaultdict(lambda: [0, 0, 0])
    for r in docs.collect():
        for i, n in enumerate((1, len(library.encode_ordinary(r["text"] or "")), len(r["text"] or ""))):
            want[r["source"], r["lang"]][i] += n
    got = {(r["source"], r["lang"]): [r["documents"], r["tokens"], r["characters"]] for r in tokens.op9_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(want)
