"""Matching of texts within texts against every pair, and where one gram is in all."""

import random

from linkspark.operators import matching as M


def test_one_prefix_for_all_numbers(spark):
    rnd = random.Random(5)
    numbers = [(f"a{i}", "501000" + f"{i:06d}") for i in range(20_000)]
    runs = [(f"d{i}", n[rnd.choice([0, 2]) :]) for i, (_, n) in enumerate(rnd.sample(numbers, 300))] + [("e", "999" + numbers[7][1]), ("n", "123456789")]
    found = M.number_matches(spark.createDataFrame(runs, "doc string, run string"), spark.createDataFrame(numbers, "id string, number string"))
    got = {tuple(r) for r in found.collect()}
    assert got == {(d, i) for d, r in runs for i, n in numbers if r in n or r.endswith(n[-12:])}


def test_a_needle_goes_to_every_part_of_a_common_gram(spark, monkeypatch):
    monkeypatch.setattr(M, "PART", 3)
    texts = [(i, "aaaa" + "bcd"[i % 3]) for i in range(50)]
    got = M.holders(spark.createDataFrame([("aaaa",), ("aaaab",), ("zzzz",)], "needle string"), spark.createDataFrame(texts, "id long, text string"), 4, "a-z")
    assert {tuple(r) for r in got.collect()} == {(w, i) for w in ("aaaa", "aaaab") for i, t in texts if w in t}


def test_best_names_equal_all_pairs(spark):
    rnd = random.Random(6)
    common, rare = ["kumar", "singh", "holder"], [f"name{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    pick = lambda: [w for w in common if rnd.random() < 0.5] + rnd.sample(rare, rnd.randint(0, 3))
    names = [(f"E{i:04d}", " ".join(pick())) for i in range(400)]
    docs = [(f"d{i}", sorted({*pick(), *(["zzzz"] if i % 9 == 0 else [])})) for i in range(200)] + [("none", [])]
    got = {r["doc"]: (r["hits"], r["id"]) for r in M.name_best(spark.createDataFrame(docs, "doc string, words array<string>"), spark.createDataFrame(names, "id string, text string")).collect()}
    want = {d: max((sum(w in t for w in ws), i) for i, t in names) for d, ws in docs}
    assert got == {d: b for d, b in want.items() if b[0]}
    assert {b[0] for b in got.values()} >= {1, 2, 3}


def test_sets_of_words_meet_and_not_documents_and_names(spark, monkeypatch):
    """Common words only: no table of a step grows with documents or names."""
    rows = []

    def written(df, name, keep=M.written):
        out = keep(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(M, "written", written)
    words = ["kumar", "singh", "holder", "mehta"]
    names = [(i, " ".join(w for k, w in enumerate(words) if i % 16 >> k & 1)) for i in range(800)]
    docs = [(d, [w for k, w in enumerate(words) if d % 16 >> k & 1][::-1]) for d in range(600)]
    got = {r["doc"]: (r["hits"], r["id"]) for r in M.name_best(spark.createDataFrame(docs, "doc long, words array<string>"), spark.createDataFrame(names, "id long, text string")).collect()}
    assert got == {d: max((sum(w in t for w in ws), i) for i, t in names) for d, ws in docs if ws}
    assert max(rows) <= 64
