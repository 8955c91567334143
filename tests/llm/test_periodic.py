"""Runs of words against brute force over every start and period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from linkspark.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, runs string, k int, start long, collapsed long"


def brute(words):
    """Every maximal stretch of a period, by its definition."""
    n, out = len(words), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(24, 3 * q) and not any(all(words[x] == words[x + p] for x in range(s, e - p)) for p in range(1, q)):
                out.add((s, q, e - s))
            i = j
    return sorted(out)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    drop = {i for s, q, m in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1])) if runs else None
    said = "".join(f"{s},{m},{q}\n" for s, q, m in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (len(runs), *top, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def crafted():
    rnd = random.Random(7)
    bits = ["a", "b", "c", "d", "é", "日本", " ", "x-y"]
    texts = [None, "", " \n\t", "one", "w " * 23, "w " * 24, "w\n" * 400, "a b " * 12 + "a", ("a b c " * 7 + "q ") * 4, ("x y " * 12 + "z ") * 5]
    texts += [" ".join(rnd.choice(bits[: rnd.randint(1, 8)]) for _ in range(rnd.randint(0, 130))) for _ in range(160)]
    for _ in range(160):
        unit = [rnd.choice(bits) + str(rnd.randint(0, 9)) for _ in range(rnd.randint(1, 40))]
        tail = [rnd.choice(bits) for _ in range(rnd.randint(0, 20))]
        made = tail + unit * rnd.randint(2, 6) + unit[: rnd.randint(0, len(unit))] + tail
        if rnd.random() < 0.4:
            made[rnd.randrange(len(made))] = "odd"
        texts.append(rnd.choice([" ", "\n", "  "]).join(made))
    return texts


def test_runs_equal_brute_force(spark):
    texts = crafted()
    rows = [(i, t, "r", 1, 2, 3) for i, t in enumerate(texts)] + [(None, texts[6], "r", 1, 2, 3), (5, texts[5], "r", 1, 2, 3)]
    got = periodic._digests(periodic.periodic_runs(spark.createDataFrame(rows, DOCS), source=periodic.repeated_by_id)).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((r[0], *expected(r[0], r[1]))) for r in rows)
    assert sum(r["n_runs"] for r in got) > 100


def test_runs_as_rows(spark):
    df = spark.createDataFrame([(1, "h " + "a b c " * 10 + "t", "r", 1, 2, 3)], DOCS)
    got = periodic.periodic_runs(df).collect()[0]
    assert [tuple(r) for r in got["runs"]] == [(1, 3, 30)] and got["collapsed"] == "h a b c t"
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_one_word_repeated_and_a_long_period():
    import numpy as np

    words = np.concatenate([np.zeros(30_000, np.int64), np.tile(np.arange(1, 5001), 4)])
    assert periodic.runs_of(words, np.zeros(len(words), np.int64)) == {0: [(0, 1, 30_000), (30_000, 5000, 20_000)]}


def test_query(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic.op11_periodic_runs(spark, sf).collect()}
    short = [(i, x) for i, x in zip(t["doc_id"], t["text"], strict=True) if len(x or "") < 6000]
    assert len(got) == len(t["doc_id"]) and all(got[i] == expected(i, x) for i, x in short)
