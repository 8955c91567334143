"""Quality rules by line-first cleaning, in DataFrame functions only.

Every line is judged alone (closing punctuation, navigation, symbols,
boilerplate); failing lines are removed; a document that loses too large a share
of its words with them is rejected, as is one that fails a base rule (too few
words, too many words in repeated three-word windows).

Defined cases: a null text counts as empty, has no words and fails the word
minimum; repeated rows give repeated result rows; an empty table gives an empty
result; other columns of the input are neither read nor kept, whatever their
names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
# The marks that end a sentence or a clause in Unicode's scripts: ASCII, the
# ellipsis, Armenian, Arabic and Urdu, Syriac, Devanagari, Tibetan, Burmese, Ethiopic, Khmer,
# Mongolian, double and mixed marks, ideographic, vertical, small and full-width forms.
CLOSING = (
    ".!?:;\u2026" "\u0589" "\u061f\u061b\u06d4" "\u0700\u0701\u0702" "\u0964\u0965" "\u0f0d\u0f0e" "\u104a\u104b" "\u1361\u1362\u1366\u1367\u1368" "\u17d4\u17d5"
    "\u1803\u1809" "\u203c\u203d\u2047\u2048\u2049" "\u3002" "\ufe12\ufe15\ufe16" "\ufe52\ufe54\ufe55\ufe56\ufe57" "\uff01\uff0e\uff1a\uff1b\uff1f\uff61"
)
#: Quotes, brackets and white space may follow.
AFTER_CLOSING = WS_CHARS + "\"')]\u201d\u2019\u00bb\u203a\u300d\u300f\uff09\u3011"
#: What stands between the entries of a menu or a breadcrumb line.
SEPARATORS = r"[|>\x{00BB}\x{2022}\x{00B7}]"
MARKS = r"[#*$%&|<>\x{00BB}\x{2022}\x{00B7}]"
#: A line fails if it holds one of these phrases, in either case.
BOILERPLATE = ("cookie", "privacy policy", "terms of use", "all rights reserved", "javascript", "lorem ipsum")
PHRASE = "(?i)" + "|".join(BOILERPLATE)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line fails with more separators than one for this many words ...
WORDS_PER_SEPARATOR = 6
#: ... or with more symbols than this share of its characters in words.
MAX_SYMBOL_PERCENT = 10
#: A document goes when its kept lines hold less than this share of its words.
MIN_KEPT_PERCENT = 50

POS_BITS = 28


def window_keys(words: Column) -> Column:
    """A sorted long for each three-word window.

    Each window gives one long, hash bits above its position, so that one sort of
    longs brings equal windows together; windows whose hash bits meet another's
    are then compared as text. Sorting keeps long documents at n log n.
    """
    n = F.size(words)
    return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(
        F.sort_array(
            F.transform(
                F.slice(words, F.lit(1), n - 2),
                lambda w, i: F.shiftleft(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), POS_BITS).bitwiseOR(i.cast("bigint")),
            )
        )
    )


def _covered(places: Column) -> Column:
    """Words covered by three-word windows at the sorted ``places``."""
    m = F.size(places)
    steps = F.zip_with(F.slice(places, F.lit(2), F.greatest(m - 1, F.lit(0))), F.slice(places, F.lit(1), F.greatest(m - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(m == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda s, x: s + x))


def line_fails(line: Column, boilerplate: Column) -> Column:
    """Whether a line that has a word fails a rule for lines. ``boilerplate``: the
    document holds such a phrase at all; counts are taken only where a cheap test
    finds something to count."""
    n = F.regexp_count(line, F.lit(f"[^{WS}]+"))
    chars = F.regexp_count(line, F.lit(f"[^{WS}]"))
    marked = (F.regexp_count(line, F.lit(SEPARATORS)) * WORDS_PER_SEPARATOR > n) | (F.regexp_count(line, F.lit(SYMBOLS)) * 100 > chars * MAX_SYMBOL_PERCENT)
    return (
        F.when(~F.contains(F.lit(CLOSING), F.right(F.rtrim(line, F.lit(AFTER_CLOSING)), F.lit(1))), True)
        .when(F.regexp_like(line, F.lit(MARKS)), marked | (boilerplate & F.regexp_like(line, F.lit(PHRASE))))
        .otherwise(boilerplate & F.regexp_like(line, F.lit(PHRASE)))
    )


def clean_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, the counts, ``kept_words``, ``cleaned`` (the
    lines that stay, joined by line ends), ``base_failed`` and ``kept``."""
    df = docs.select(F.col(key).alias("k"), text_of(docs, text).alias("t"))
    low = F.lower("t")
    df = df.select("k", "t", words_of(F.col("t")).alias("w"), F.split("t", "\n", -1).alias("lines"), reduce(or_, [F.contains(low, F.lit(x)) for x in BOILERPLATE]).alias("phrase"))
    df = df.select(
        "k",
        "w",
        "phrase",
        F.filter("lines", lambda x: F.regexp_like(x, F.lit(f"[^{WS}]"))).alias("lines"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.when(F.regexp_like("t", F.lit(SYMBOLS)), F.regexp_count("t", F.lit(SYMBOLS))).otherwise(0).alias("n_symbols"),
        window_keys(F.col("w")).alias("keys"),
    )
    high = lambda x: F.shiftright(x, POS_BITS)
    df = df.select(
        *df.columns,
        F.exists(F.zip_with("keys", F.slice("keys", F.lit(2), F.size("keys")), lambda a, b: high(a) == high(b)), lambda x: x).alias("again"),
        F.filter("lines", lambda x: line_fails(x, F.col("phrase"))).alias("bad"),
    )
    beside = lambda x, i: (high(x) == high(F.get(F.col("keys"), i - 1))) | (high(x) == high(F.get(F.col("keys"), i + 1)))
    df = df.select(*df.columns, F.when(F.col("again"), F.filter("keys", beside)).otherwise(F.array().cast("array<bigint>")).alias("near"))
    window = lambda p: F.concat_ws(" ", F.get(F.col("w"), p), F.get(F.col("w"), p + 1), F.get(F.col("w"), p + 2))
    place = lambda x: x.bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int")
    df = df.withColumn("near", F.array_sort(F.transform("near", lambda x: F.struct(window(place(x)).alias("g"), place(x).alias("p")))))
    same = lambda x, i, by: F.coalesce(x["g"] == F.get(F.col("near"), i + by)["g"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("near", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["p"]))
    df = df.withColumn("places", places)
    lost = F.aggregate("bad", F.lit(0), lambda s, x: s + F.regexp_count(x, F.lit(f"[^{WS}]+")))
    df = df.select(
        F.col("k").alias(key),
        F.size("w").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).cast("long").alias("n_repeat_words"),
        (F.size("w") - lost).cast("long").alias("kept_words"),
        F.array_join(F.when(F.size("bad") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~line_fails(x, F.col("phrase")))), "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("kept_words") * 100 >= F.col("n_words") * MIN_KEPT_PERCENT))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The counts and the verdict for every document."""
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cleaned")
