"""Kneser-Ney models as distributions, rejection, and the cases of language ID."""

import gc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkspark.llm import language


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs)


@pytest.mark.parametrize("context", ["", "a", "ab", "abc", "abca", "zzzz", "?"])
def test_the_next_symbol_has_probabilities_that_sum_to_one(context):
    made = language.learn({"en": ["abc abd bcd cab abca " * 5] * 20, "xx": ["xyz yzx zxy abz " * 5] * 20})
    seen = sorted({c for c in "abcdxyz"})
    n = len(context)
    at = lambda word, place: np.exp(made.symbol_logs([word])[1][place])
    total = sum(at(context + c, n) for c in [*seen, "\u4e00"])
    total = total + (at(context, n) if context else at("", 0))  # the end of the word
    assert np.allclose(total, 1, atol=1e-4)


def test_clean_documents_are_accepted_and_strangers_rejected(spark, docs, model):
    found = language.predict(docs, model).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").toPandas()
    held = found[found.held_out & (found.n >= 40)]
    assert held.accepted.mean() > 0.99
    strange = {
        "ru": "В начале было слово и слово было у бога и слово было бог все через него начало быть",
        "fi": "kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu jarki ja omatunto",
        "noise": "xkq zzvw qpfj wvxz kkjq zxcv bnmq wrtp lkjh gfds zxqw vbnk pqzx mnvc",
    }
    rows = [(k, lang, t * times) for k, (lang, t) in enumerate(strange.items()) for times in (1, 30)]
    out = language.predict(spark.createDataFrame(rows, "doc_id long, was string, text string"), model).collect()
    assert not [r["doc_id"] for r in out if r["accepted"]]


def test_cases(spark, docs, model):
    some = docs.where("length(text) > 200").select("text").first()[0]
    rows = [(1, some), (1, some), (2, some + " " + "a" * 200_000), (3, some * 400), (4, None), (5, " "), (6, "x" * 100_000), (None, some)]
    out = language.predict(spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit("")).withColumn("score", F.lit(1)), model).collect()
    assert len(out) == 8
    said = {r["doc_id"]: r for r in out}
    assert said[3]["lang_pred"] == said[1]["lang_pred"] == said[None]["lang_pred"] and said[4]["lang_pred"] == said[5]["lang_pred"] == "und" and not said[None]["held_out"]


def test_ties_go_to_the_first_name():
    same = ["one two three four " * 3] * 20
    made = language.learn({"b": same, "a": same})
    assert [x[0] for x in language.Scorer(made).predict(["one two"])] == ["a"]


def test_long_words_are_not_remembered(model):
    scorer = language.Scorer(model)
    first = list(scorer.entropies(["word " + "abc" * 100]))
    again = list(scorer.entropies(["more words here", "word " + "abc" * 100]))[1]
    assert np.allclose(first[0][0], again[0]) and max(map(len, scorer.known)) <= language.LONGEST


def test_no_model_stays_in_a_worker_once_its_task_ended(spark, docs, model):
    language.predict(docs, model).collect()

    def held(batches):
        n = [sum(type(x).__name__ == "Scorer" for x in gc.get_objects()) for _ in batches]
        yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64())})

    found = [r["n"] for r in spark.range(64).repartition(8).mapInArrow(held, "n long").collect()]
    assert found and not any(found)


@pytest.mark.parametrize("text", ["string", "binary"])
def test_a_carried_row_is_judged_by_its_own_text(spark, docs, model, text):
    rows = docs.select("doc_id", "text", "lang").limit(300).union(spark.createDataFrame([(-1, None, "x"), (-2, "", None), (None, "12 !?", "x")], "doc_id long, text string, lang string"))
    rows = rows.withColumn("text", F.col("text").cast(text)).cache()
    said = ["held_out", "lang_pred", "score", "accepted"]
    plain = language.predict(rows, model).select("doc_id", *said)
    kept = language.predict(rows, model, keep=True)
    assert kept.select("row.*").exceptAll(rows).count() == 0 == rows.exceptAll(kept.select("row.*")).count()
    assert kept.select("row.doc_id", *said).exceptAll(plain).count() == 0 == plain.exceptAll(kept.select("row.doc_id", *said)).count()
    # the text is sent once where it needs no cast
    sent = kept._jdf.queryExecution().analyzed().toString().partition("MapInArrow")[2].split("\n")[1]
    assert (" AS t#" in sent) == (text == "binary")
