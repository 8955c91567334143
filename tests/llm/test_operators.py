"""The training-data operators against brute force, on crafted rows with the cases
that each docstring defines: nulls, empty and long texts, ties, repeated rows, empty
tables, and columns whose names clash."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.llm import importance, language, licenses, mixing, neardup, neighbours, pieces, quality, secrets, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, size long, rank int, node long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, langs=None, sources=None):
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", 0, "k", 1, 1, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    bits = ["word", "a", "the", "b.", "\n", " ", "  ", "é", "日本", "#", "|", "same same same same", "token=abcdef12", "password: x", "AKIA" + "Z" * 16, "deadbeef" * 3, "▁", "<s>", " "]
    made = [" ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    return [*made, None, "", " \n\t", "x" * 20000, made[0], made[0], "token=abcdefg " * 1500]


def test_license_lines_and_texts(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    other = "Copyright (c) 2020 Someone\n" + mit.upper().replace("SUBLICENSE", "sub-license").replace(",", " ;")
    df = table(spark, [mit, other, "x\nReleased under the MIT license\ny", None, "", mit + " more"])
    got = {r["doc_id"]: (r["license"], r["n_notices"], r["notices"]) for r in licenses.scan(df).collect()}
    assert got == {0: ("MIT", 0, ""), 1: ("MIT", 0, ""), 2: (None, 1, "MIT"), 3: (None, 0, ""), 4: (None, 0, ""), 5: (None, 0, "")}
    assert licenses.scan(df.limit(0)).count() == 0


def test_pieces_equal_the_library(spark, texts):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    df = table(spark, texts)
    got = {r["doc_id"]: r for r in pieces.encode(df, path).collect()}
    digests = {r["doc_id"]: r for r in pieces.round_trip(df, path).collect()}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(df, path), path).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert got[i]["ids"] == ids
        proto = sp.encode(t or "", return_type="proto")
        assert list(zip(got[i]["starts"], got[i]["ends"])) == [(p.begin, p.end) for p in proto.pieces]
        assert back[i] == sp.decode(ids) if ids else back[i] == ""
        assert digests[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert pieces.encode(df.limit(0), path).count() == 0


def test_compiled_character_map():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(n.serialized_model_proto())
    own = pieces.Normalizer(proto.normalizer_spec)
    for t in ["ﬁ Ａ１ ㌔", "  a  b ", "é é", "ｶﾞ…", "", " "]:
        text, places = own.aligned(t.encode())
        assert text.decode() == n.normalize(t)
        assert len(places) == len(text) + 1 and (np.diff(places) >= 0).all()


def test_secrets_equal_brute_force(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r["k"]: [tuple(x) for x in r["spans"] if x["kind"] < 3] for r in secrets.scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), k, m.end()) for k, p, n in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)) for m in re.finditer(p, t) if len(m[0]) >= n]
        assert got[i] == sorted(want)
    assert secrets.scan(table(spark, texts).limit(0)).count() == 0


def test_every_match_satisfies_its_trigram_query():
    def ok(q, t):
        return q is True or (q in t if isinstance(q, str) else (all if q[0] == "and" else any)(ok(p, t) for p in q[1:]))

    for kind, text in {"assign": "x API_KEY = 'abcdef'", "access": "AKIA" + "Q" * 16, "private_key": "-----BEGIN RSA PRIVATE KEY-----", "code_host": "ghp_" + "a" * 36, "chat": "xoxb-1234567890", "payment": "sk_live_" + "a" * 16}.items():
        rule = next(r for r in secrets.RULES if r.kind == kind)
        assert re.search(rule.pattern, text) and ok(secrets.trigram_query(rule.pattern), text.lower())
    assert secrets.trigram_query(r"[0-9a-f]+") is True


def test_masking_leaves_the_rest(spark):
    out = {r["doc_id"]: r["text"] for r in secrets.redact(table(spark, ["a token=abcdef12 b", "plain", None, "password: x"])).collect()}
    assert out == {0: "a token=<secret> b", 1: "plain", 2: None, 3: "password: x"}


def test_importance_prefers_the_target(spark):
    good, bad = ["alpha beta gamma delta"] * 50, ["one | two | three |"] * 50
    df = table(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 50)) for i in range(100)], "doc_id long, quality int")
    r = importance.resample(df, labels).toPandas()
    assert len(r) == 102 and r.kept.sum() == round(102 * 0.5) and r[r.doc_id < 50].kept.all()
    assert importance.resample(df, labels, share=0.0).where("kept").count() == 0
    assert importance.resample(df.limit(0), labels).count() == 0


def test_top_is_the_sorted_top(spark):
    rows = spark.createDataFrame([(i, 0, 0.0, float(i % 7)) for i in range(500)], "id long, h long, log_ratio double, gumbel_key double")
    for k in (0, 1, 77, 499, 500):
        kept = importance.top(rows, k, bins=8).where("kept").collect()
        assert len(kept) == k
        want = sorted(((-(i % 7), i) for i in range(500)))[:k]
        assert {r["id"] for r in kept} == {i for _, i in want}


def test_mix_fills_by_weight(spark):
    rnd = random.Random(2)
    rows = ["w " * rnd.randint(0, 9) for _ in range(3000)]
    sources = [rnd.choice(["a", "a", "a", "b", "c", None]) for _ in rows]
    df = table(spark, [*rows, None], sources=[*sources, "zz"])
    p = mixing.mix(df).toPandas()
    assert len(p) == 3001 and (p.copies <= 2).all() and (p[p["size"] == 0].copies == 0).all()
    g = p.assign(taken=p["size"] * p.copies, source=p.source.fillna("~")).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert np.allclose(g.target.sum(), 1.5 * g["size"].sum()) and (abs(g.taken - g.target) <= 20).all()
    again = mixing.mix(df.repartition(7)).toPandas()
    assert dict(zip(p.doc_id, p.copies)) == dict(zip(again.doc_id, again.copies))
    assert mixing.mixed(df).count() == p.copies.sum()
    assert mixing.mix(df.limit(0)).count() == 0


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    r = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.97 and r.score.between(0, 1).all()
    odd = {x["doc_id"]: x["lang_pred"] for x in language.predict(table(spark, [None, "", "12 !?"]), model).collect()}
    assert set(odd.values()) == {"und"}
    empty = language.train(docs.limit(0))
    assert language.predict(docs.limit(3), empty).where("lang_pred = 'und'").count() == 3


def test_model_is_a_distribution():
    model = language.learn({"en": ["abc abd bcd " * 5] * 20, "xx": ["xyz yzx zxy " * 5] * 20})
    # over the next letter or the end after a known context
    letters = "abcdxyz"
    base = model.word_scores(["ab"])[0]
    nexts = np.array([np.exp(model.word_scores(["ab" + c])[0] - base) for c in letters])
    assert (nexts > 0).all() and model.languages == ["en", "xx"]


def test_quality_counts(spark, texts):
    got = {r["doc_id"]: r for r in quality.clean_lines(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        again = {j + d for j, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    assert quality.clean_lines(table(spark, texts).limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((3000, 16)).astype(np.float32)
    v[5:40] = v[4]
    rows = [(i, [float(x) for x in v[i]]) for i in range(3000)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    r = neighbours.search(df).toPandas()
    assert set(r.query_id) == set(range(0, 3000, 50)) and (r.groupby("query_id").size() == 5).all()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = 0
    for q, g in r.groupby("query_id"):
        s = u @ u[q]
        s[q] = -9
        want = sorted(range(3000), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len(set(want) & set(g.vec_id))
        assert np.allclose(g.sort_values("rank").score, np.sort([s[i] for i in g.vec_id])[::-1])
    assert hits >= 0.9 * 5 * r.query_id.nunique()
    few = neighbours.search(df.where("vec_id in (0, 1, 2)")).toPandas()
    assert len(few) == 2
    assert neighbours.search(df.limit(0)).count() == 0


def test_rollup_counts_once(spark, tmp_path):
    import public_tokenizers as vocabulary

    how = ("t1", vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN)
    roll = tokens.Rollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("b0", "s", "en", "hello world", 1), ("b0", None, "en", None, 1)], "batch string, source string, lang string, text string, sign int")
    roll.commit(rows, *how)
    roll.commit(rows, *how)
    changes = spark.createDataFrame([("revise", "s", "en", "hello", "s", "en", "hello world"), ("delete", None, None, None, None, "en", None)], "op string, source string, lang string, text string, old_source string, old_lang string, old_text string")
    roll.commit(tokens.signed_changes(changes).withColumn("batch", F.lit("b1")), *how)
    got = {r["source"]: (r["documents"], r["tokens"], r["characters"]) for r in roll.totals().collect()}
    assert got == {"s": (1, 1, 5)}


def brute_jaccard(a, b):
    na, nb = sum(a.values()), sum(b.values())
    x, y = {k: v / na for k, v in a.items()}, {k: v / nb for k, v in b.items()}
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in {*x} & {*y})


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(4)
    base = [[f"w{rnd.randint(0, 300)}" for _ in range(80)] for _ in range(25)]
    made = []
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(rnd.randint(0, 5)):
                c[rnd.randrange(len(c))] = f"n{rnd.randint(0, 999)}"
            made.append(" ".join(c))
    made += [made[0], made[0], None, "", "", "one two", "one two", "x " * 3000]
    sets = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None for w in ((t or "").split() for t in made)]
    parent = list(range(len(made)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(made)):
        for j in range(i):
            if sets[i] and sets[j] and brute_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    df = table(spark, made)
    got = {r["id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {i: root(i) for i in range(len(made))}
    assert sorted(r["doc_id"] for r in neardup.first_of_each(df).collect()) == sorted(set(got.values()))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_every_class_keeps_one_row_without_ids_of_its_own(spark):
    said = lambda w, n=30: " ".join(f"{w}{i}" for i in range(n))
    made = [(None, said("a")), (None, said("b")), (None, said("b")), (None, said("c", 60)), (None, said("c", 60) + " end"), (7, said("d")), (7, said("e")), (8, said("e")), (9, said("f")), (9, said("g")), (9, said("g")), (None, said("g")), (3, ""), (None, " ")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    rows = neardup.near_duplicates(df).collect()
    kinds = collections.Counter((r["class_id"], r["class_node"]) for r in rows)
    assert sorted(kinds.values()) == sorted([1, 2, 2, 1, 2, 1, 3, 1, 1]) and len({n for _, n in kinds}) == 9
    left = [(r["doc_id"], r["text"][:1]) for r in neardup.first_of_each(df).collect()]
    assert collections.Counter(left) == collections.Counter([(None, "a"), (None, "b"), (None, "c"), (7, "d"), (7, "e"), (9, "f"), (9, "g"), (3, ""), (None, " ")])


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(40):
        a = rng.integers(0, 150, 200)
        b = np.where(rng.random(200) < 0.2, rng.integers(0, 300, 200), a)
        ca, cb = collections.Counter(a.tolist()), collections.Counter(b.tolist())
        ha, hb = (neardup._mix(np.array(sorted(c), np.uint64)) for c in (ca, cb))
        na, nb = (np.array([c[k] for k in sorted(c)]) for c in (ca, cb))
        s = neardup.signatures(np.repeat([0, 1], [len(ha), len(hb)]), np.concatenate([ha, hb]), np.concatenate([na, nb]), 2)
        gaps.append((s[0] == s[1]).mean() - brute_jaccard(ca, cb))
    assert abs(np.mean(gaps)) < 0.03
