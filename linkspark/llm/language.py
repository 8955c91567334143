"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Each learned language has one model of the characters in its words, up to four
characters of context, begun and ended at word edges. Counts of every order are
hashed and sorted; a row of the arrays holds the finished log-probability for each
language, so one search serves all. A text goes to the language with the lowest
cross-entropy per character.

A text is rejected if its excess over the language's mean, times the root of its
length (400 characters at most), is over a limit. The limit is calibrated for each
language between the excesses of its own held-back texts (the OWN quantile) and those
of strangers (the OTHER quantile): the held-back texts of other languages, and its own
ones with their letters in random order. It lies MARGIN of the way to the strangers,
and at the largest of its own excesses if these reach them.

Learning uses a bounded sample: for each language the texts first in the order of a
hash, up to SAMPLE_TEXTS texts and SAMPLE_CHARS characters; of a text of more than a
tenth of that, a stretch of so many at a place drawn by its hash. Every tenth text is held back, or, of fewer than
ten, none: then its training texts stand in. Every text is predicted whole.

Defined cases: a null text, or one without a letter, gives ``und``, score 0, not
accepted; equal cross-entropies go to the language first by name; repeated rows
give repeated result rows; an empty table gives an empty result, and a table
without one learnable row gives ``und`` for all; other columns of the input are
not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, text_of

SAMPLE_TEXTS, SAMPLE_CHARS = 600, 600_000
ORDER = 5
#: Words that a task remembers the scores of, and the characters of the longest one.
REMEMBERED, LONGEST = 150_000, 64
#: The quantile of a language's own excesses, and the limit's place between it and strangers.
OWN, MARGIN = 0.98, 0.75
#: Characters from which on a text's length makes its limit no tighter.
FULL = 400
ROWS = 256
UNKNOWN = "und"
EDGE = 0


def letters(word: str) -> str:
    """A word as the models see it: its letters alone, in lower case."""
    return word if word.isalpha() and word.islower() else "".join(c for c in word.lower() if c.isalpha())


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For every character to predict (each letter and the end of each word): its
    word's place, how much context it has, and its hashed n-grams of every order."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    codes = np.full(int(ends[-1]) if len(ends) else 0, EDGE, np.uint64)
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = inner[ends - sizes] = False
    codes[inner] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    hashes, run = [], np.zeros(len(codes), np.uint64)
    for n in range(ORDER):
        back = np.zeros(len(codes), np.uint64)
        back[n:] = codes[: max(0, len(codes) - n)] + np.uint64(1)
        power = pow(0x9E3779B97F4A7C15, n + 1, 1 << 64)
        mixed = (back ^ (back >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
        run = run + (mixed ^ (mixed >> np.uint64(29))) * np.uint64(power)
        hashes.append(run ^ np.uint64((n + 1) * 0x2545F4914F6CDD1D & (2**64 - 1)))
    wanted = place > 0
    return owner[wanted], np.minimum(place[wanted], ORDER - 1), [h[wanted] for h in hashes]


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of ``asked`` in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


@dataclass
class Model:
    """Sorted hashes of n-grams with the log-probability of their last character in
    each language, and of contexts with the log-weight of the next shorter one."""

    languages: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    base: float
    limits: np.ndarray  # mean and allowed excess of each language's cross-entropy
    sharpness: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word, end included, in each language."""
        if not self.languages:
            return np.zeros((len(words), 0))
        owner, found = self.symbol_logs(words)
        out = np.zeros((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, found[:, k], len(words))
        return out

    def symbol_logs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of every letter and word end: its word's place, and its log-probability in
        each language."""
        owner, context, hashes = _grams(words)
        found = np.zeros((len(owner), len(self.languages)), np.float32)
        at = context.copy()
        for n in range(ORDER - 1, -1, -1):
            now = np.flatnonzero(at == n)
            if not len(now):
                continue
            asked, back = np.unique(hashes[n][now], return_inverse=True)
            row = _find(self.grams[n], asked)[back]
            hit = row >= 0
            found[now[hit]] += self.logs[n][row[hit]]
            miss = now[~hit]
            if n == 0:  # never seen: the weight that seen symbols leave, evenly over all
                found[miss] += self.weights[0][0] + self.base
                continue
            # the shorter context stands in, at the weight that this one leaves it
            row = _find(self.contexts[n], _context(hashes, n, miss))
            hit = row >= 0
            found[miss[hit]] += self.weights[n][row[hit]]
            at[miss] = n - 1
        return owner, found


def _context(hashes: list[np.ndarray], n: int, which: np.ndarray) -> np.ndarray:
    """Hashes of the n characters before the last one of n-grams of order n + 1: the
    longer sum without its first term."""
    strip = np.uint64((n + 1) * 0x2545F4914F6CDD1D & (2**64 - 1)), np.uint64(0x2545F4914F6CDD1D)
    return (hashes[n][which] ^ strip[0]) - (hashes[0][which] ^ strip[1])


def learn(texts: dict[str, list[str]]) -> Model:
    """The models from whole texts of each language; every tenth text is held back
    to set the limits and the score's sharpness."""
    names = sorted(texts)
    words = {name: Counter(w for i, t in enumerate(texts[name]) if i % 10 != 9 for x in t.split() if (w := letters(x))) for name in names}
    alphabet = {c for count in words.values() for w in count for c in w}
    base = -np.log(len(alphabet) + 2)
    per = []
    for name in names:
        kinds = list(words[name])
        owner, context, hashes = _grams(kinds)
        times = np.fromiter(words[name].values(), np.int64, len(kinds))[owner]
        orders = []
        for n in range(ORDER):
            ok = context >= n
            keys, first, back = np.unique(hashes[n][ok], return_index=True, return_inverse=True)
            raw = np.bincount(back, times[ok], len(keys))
            if n < ORDER - 1:  # how many characters an n-gram follows; its own count if it begins the word
                longer = context >= n + 1
                wide, at = np.unique(hashes[n + 1][longer], return_index=True)
                narrow = hashes[n][longer][at]
                kn = np.bincount(_find(keys, narrow), minlength=len(keys)).astype(float)
                count = np.where(context[ok][first] == n, raw, kn) if n else np.maximum(kn, 1)
                del wide
            else:
                count = raw
            ctx = _context(hashes, n, np.flatnonzero(ok))[first]
            orders.append((keys, count, ctx))
        per.append(orders)
    grams, logs, contexts, weights = [], [], [], []
    for n in range(ORDER):
        keys = np.unique(np.concatenate([orders[n][0] for orders in per]))
        ctxs = np.unique(np.concatenate([orders[n][2] for orders in per]))
        # any language's occurrence tells an n-gram's context and its shorter form
        ctx_of, short_of = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for name in names:
            _, context, hashes = _grams(list(words[name]))
            ok = np.flatnonzero(context >= n)
            at = _find(keys, hashes[n][ok])
            ctx_of[at] = _context(hashes, n, ok)
            if n:
                short_of[at] = hashes[n - 1][ok]
        log, weight = np.zeros((len(keys), len(names)), np.float32), np.zeros((len(ctxs), len(names)), np.float32)
        for k, orders in enumerate(per):
            own, count, ctx = orders[n]
            at = _find(ctxs, ctx)
            total = np.bincount(at, count, len(ctxs))
            kinds = np.bincount(at, minlength=len(ctxs))
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            rest = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            weight[:, k] = np.log(rest)
            lower = np.exp(logs[n - 1][_find(grams[n - 1], short_of), k]) if n else np.exp(base)
            of = _find(ctxs, ctx_of)
            seen = np.zeros(len(keys))
            seen[_find(keys, own)] = np.maximum(count - discount, 0) / total[at]
            log[:, k] = np.log(seen + rest[of] * lower)
        grams.append(keys), logs.append(log), contexts.append(ctxs), weights.append(weight)
    model = Model(names, grams, logs, contexts, weights, base, np.zeros((len(names), 2)), 1.0)
    return _calibrate(model, texts)


def shuffled(text: str, seed: int) -> str:
    """The words of a text with all its letters in random order."""
    words = [w for x in text.split() if (w := letters(x))]
    mixed = iter(np.random.default_rng(seed).permutation(list("".join(words))).tolist())
    return " ".join("".join(next(mixed) for _ in w) for w in words)


def _calibrate(model: Model, texts: dict[str, list[str]]) -> Model:
    held = [(k, t) for k, name in enumerate(model.languages) for i, t in enumerate(texts[name]) if i % 10 == 9 or len(texts[name]) < 10]
    scorer = Scorer(model)
    of = [(k, *scorer.entropy(t)) for k, t in held]
    of = [(k, e, n) for k, e, n in of if n]
    noise = [(k, *scorer.entropy(shuffled(t, i))) for i, (k, t) in enumerate(held)]
    for k in range(len(model.languages)):
        own = np.array([(e[k], n) for j, e, n in of if j == k])
        if not len(own):
            model.limits[k] = (0.0, np.inf)
            continue
        mean = np.average(own[:, 0], weights=own[:, 1])
        excess = lambda rows: np.array([(e - mean) * np.sqrt(min(n, FULL)) for e, n in rows])  # noqa: E731, B023
        inner = excess(own)
        kinds = [[(e[k], n) for j, e, n in of if j == other] for other in range(len(model.languages)) if other != k] + [[(e[k], n) for j, e, n in noise if j == k and n]]
        low, high = np.quantile(inner, OWN), min((np.median(excess(rows)) for rows in kinds if rows), default=np.inf)
        model.limits[k] = (mean, low + MARGIN * (high - low) if high > low else inner.max())
    best = np.inf
    for sharp in (0.5, 1, 2, 4, 8, 16, 32):
        loss = sum(np.log(np.exp(-sharp * np.sqrt(n) * (e - e[k])).sum()) for k, e, n in of)
        if loss < best:
            best, model.sharpness = loss, float(sharp)
    return model


class Scorer:
    """A model in a task, remembering the words it has scored."""

    def __init__(self, model: Model):
        self.model, self.known, self.rows, self.used = model, {}, np.zeros((1024, len(model.languages) + 1)), 0

    def _learn(self, texts: list[str]) -> tuple[list[Counter], dict[str, int]]:
        """The words of each text, and the row of every word that is not remembered:
        long words, whose rows are overwritten by what comes next."""
        counts = [Counter(t.split()) for t in texts]
        if self.used > REMEMBERED:
            self.known, self.used = {}, 0
        new = sorted((w for w in set().union(*counts) if w not in self.known), key=lambda w: len(w) > LONGEST)
        short = sum(len(w) <= LONGEST for w in new)
        if new:
            plain = [letters(w) for w in new]
            have = [i for i, w in enumerate(plain) if w]
            rows = np.zeros((len(new), self.rows.shape[1]))
            if have:
                rows[have, :-1] = self.model.word_scores([plain[i] for i in have])
                rows[have, -1] = [len(plain[i]) + 1 for i in have]
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : self.used + len(new)] = rows
            at = dict(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.known.update((w, at[w]) for w in new[:short])
            self.used += short
            return counts, {w: at[w] for w in new[short:]}
        return counts, {}

    def entropies(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
        """Each text's cross-entropy in each language, and its characters counted."""
        counts, once = self._learn(texts)
        known = self.known
        for count in counts:
            at = np.fromiter((known[w] if w in known else once[w] for w in count), np.int64, len(count))
            sums = np.fromiter(count.values(), np.float64, len(count)) @ self.rows[at]
            yield -sums[:-1] / max(sums[-1], 1), int(sums[-1])

    def entropy(self, text: str) -> tuple[np.ndarray, int]:
        return next(self.entropies([text]))

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float, bool]]:
        model = self.model
        for e, n in self.entropies(texts):
            if not n or not model.languages:
                yield UNKNOWN, 0.0, False
                continue
            k = int(np.argmin(e))
            mean, allowed = model.limits[k]
            score = 1 / np.exp(-model.sharpness * np.sqrt(n) * (e - e[k])).sum()
            yield model.languages[k], float(score), bool((e[k] - mean) * np.sqrt(min(n, FULL)) <= allowed)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 == 2


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model from the bounded sample of the rows that may be learned from."""
    may = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    may = may.where(~F.coalesce(held_out(F.col("k")), F.lit(False)) & F.col("t").rlike(r"\p{L}") & F.col("l").isNotNull())
    may = may.withColumn("h", F.xxhash64("k", "t"))
    # of a long text a stretch at a place drawn by its hash, so that no language is left out for its lengths
    long, n = SAMPLE_CHARS // 10, F.length("t")
    may = may.withColumn("t", F.when(n > long, F.substring("t", F.pmod("h", n - long + 1).cast("int") + 1, F.lit(long))).otherwise(F.col("t")))
    order = Window.partitionBy("l").orderBy("h", "k")
    first = may.select("l", "k", "h", F.length("t").alias("n")).withColumn("lot", F.pmod("h", F.lit(1024)))
    # first within lots, so that a large language is not ranked in one task
    for keys in (("l", "lot"), ("l",)):
        first = first.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "k"))).where(F.col("nth") <= (SAMPLE_TEXTS // 10 if "lot" in keys else SAMPLE_TEXTS))
    first = first.withColumn("sum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("sum") <= SAMPLE_CHARS)
    # at most SAMPLE_TEXTS narrow rows for each language
    sample = may.join(F.broadcast(first.select("l", "h").distinct()), ["l", "h"], "left_semi").dropDuplicates(["l", "h"])
    texts: dict[str, list[str]] = {}
    for row in sample.orderBy("l", "h").select("l", "t").toLocalIterator():
        texts.setdefault(row["l"], []).append(row["t"])
    return learn(texts) if texts else Model([], [], [], [], [], 0.0, np.zeros((0, 2)), 1.0)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``key, held_out, lang_pred, score, accepted`` for every row; with ``keep`` the
    whole row of ``docs`` as the struct ``row`` in place of ``key``."""
    import pickle

    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.col(key)
    # a row that is carried has its text, which is not sent twice
    place = docs.columns.index(text) if keep and dict(docs.dtypes).get(text) == "string" else None
    only = docs.select(carried.alias("k"), F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), *([text_of(docs, text).alias("t")] if place is None else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of this task: what a worker keeps would take room beside all that runs after
        scorer = Scorer(pickle.loads(sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(2) if place is None else part.column(0).field(place)
                said = list(zip(*scorer.predict([t or "" for t in texts.to_pylist()]), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, kind) for x, kind in zip(said, (pa.string(), pa.float64(), pa.bool_()), strict=True))], names=["k", "held_out", "lang_pred", "score", "accepted"])

    carried_type = only.schema["k"].dataType.simpleString()
    found = map_batches(only, run, f"k {carried_type}, held_out boolean, lang_pred string, score double, accepted boolean")
    return found.withColumnRenamed("k", "row" if keep else key)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))
