"""Passages that repeat across documents against brute force over all strings of K bytes."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from linkspark.llm import passages

K = 50
DOCS = "doc_id long, text string, block long, place int, n string, a binary, kind int, t string"


def brute(rows):
    """For each row the removed bytes, as a mask."""
    least = {}
    for i, t in rows:
        data, own = (t or "").encode(), passages.LAST if i is None else i
        for a in range(len(data) - K + 1):
            s = data[a : a + K]
            least[s] = min(own, least.get(s, own))
    out = []
    for i, t in rows:
        data, own = (t or "").encode(), passages.LAST if i is None else i
        gone = bytearray(len(data))
        for a in range(len(data) - K + 1):
            if least[data[a : a + K]] < own:
                gone[a : a + K] = b"\x01" * K
        out.append((i, data, bytes(gone)))
    return out


def spans(gone):
    marks = [0, *gone, 0]
    edges = [x for x in range(1, len(marks)) if marks[x] != marks[x - 1]]
    return [(a - 1, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def crafted(seed=1, n=90):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdéż日") for _ in range(rnd.randint(1, 7)))
    passage = [" ".join(word() for _ in range(rnd.choice([8, 12, 30, 80]))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passage)
            a = rnd.randrange(len(p))
            parts += [p[a:] if rnd.random() < 0.5 else p, word()]
        texts.append(rnd.choice([" ", "\n"]).join(parts))
    texts += ["", None, "x" * 49, "x" * 50, "x" * 300, "xy" * 200, "x" * 120 + "y", "\0" * 80, "\0" * 81, texts[3], texts[3], texts[5], texts[4] * 3]
    ids = rnd.sample(range(-50, 1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    return [*rows, rows[7], (rows[8][0], texts[9]), (None, texts[10]), (None, texts[11] + texts[12]), (None, texts[11])]


def compare(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 1, 2, "n", b"a", 3, "t") for i, t in rows], DOCS).repartition(parts)
    got = passages.without_repeats(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(repr, r[1:]))
    want = [(i, len(d), spans(g), bytes(x for x, y in zip(d, g, strict=True) if not y)) for i, d, g in brute(rows)]
    assert sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got), key=key) == sorted(want, key=key)
    return sum(len(r[2]) for r in want)


def test_equal_to_brute_force(spark):
    assert compare(spark, crafted()) > 50


def test_small_bounds(spark, monkeypatch):
    # the steps alone, here in one process, so that the bounds can be made small
    rows = crafted(2, 40)
    for name, value in (("BLOCK", 900), ("PIECE", 200), ("COMMON", 2), ("HASHES", 700), ("STRETCHES", 900)):
        monkeypatch.setattr(passages, name, value)
    data, offsets = passages._buffer(pa.array([t or "" for _, t in rows]))
    assert offsets[-1] == len(data)
    texts = pa.table({"place": list(range(len(rows))), "block": [0] * len(rows), "id": [i for i, _ in rows], "n": [len((t or "").encode()) for _, t in rows], "t": [t or "" for _, t in rows]})
    none = pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    blocks = [texts.slice(a, 9).set_column(1, "block", pa.array([a] * min(9, len(rows) - a), pa.int64())) for a in range(0, len(rows), 9)]
    answers = lambda sent, run: [run(g) for g in by(sent, "range")]

    def by(table, name):
        whole = pa.concat_tables(table)
        return [whole.filter(pa.array(whole.column(name).to_numpy() == v)) for v in sorted(set(whole.column(name).to_pylist()))]

    def notes(parts, block):
        whole = pa.concat_tables(parts)
        return whole.filter(pa.array(whole.column("block").to_numpy() == block))

    shared = answers([passages._hashes(b, none, 5) for b in blocks], passages._shared)
    assert any(1 in b for t in shared for b in t.column("b").to_pylist()), "some hash is common"
    sent = [passages._stretches(b, notes(shared, b.column("block")[0].as_py()), 7) for b in blocks]
    found = answers(sent, passages._repeated)
    got = pa.concat_tables([passages._kept(b, notes(found, b.column("block")[0].as_py())) for b in blocks]).to_pylist()
    want = [(i, bytes(x for x, y in zip(d, g, strict=True) if not y), spans(g)) for i, d, g in brute(rows)]
    assert [(r["id"], r["kept"], [(s["start"], s["end"]) for s in r["spans"]]) for r in got] == want


@pytest.mark.parametrize("letters", [1, 2, 4, 20])
def test_borders_are_common_prefixes(letters):
    rnd = np.random.default_rng(letters)
    for depth in (3, 8, 50):
        parts = [np.append(rnd.integers(97, 97 + letters, rnd.integers(1, 90)), passages.END) for _ in range(25)]
        data = np.concatenate([*parts, parts[0], parts[1][5:]]).astype(np.uint8)
        order = passages.suffix_order(data, depth)
        twice = np.concatenate([data, data, data]).tobytes()
        heads = [twice[i : i + depth] for i in order]
        assert heads == sorted(heads)
        edge = passages.borders(data[order - 1], depth)
        whole = [bytes([passages.END]) not in h for h in heads]
        for i in range(1, len(heads)):
            if whole[i] or whole[i - 1]:
                assert edge[i] == (heads[i] != heads[i - 1])


def test_empty_table(spark):
    assert passages.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    want = {}
    for i, d, g in brute(list(zip(t["doc_id"], t["text"], strict=True))):
        kept = bytes(x for x, y in zip(d, g, strict=True) if not y)
        want[i] = (len(d), sum(g), len(spans(g)), hashlib.sha256(kept).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in passages.op12_repeated_passages(spark, sf).collect()} == want


def stepped(rows, ranges=5):
    """The rows' removed spans by the steps alone, one row a block."""
    none = pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    blocks = [pa.table({"place": [0], "block": [b], "id": [i], "n": [len(t.encode())], "t": [t]}) for b, (i, t) in enumerate(rows)]

    def of(parts, name, run):
        whole = pa.concat_tables(parts)
        return {v: run(whole.filter(pa.array(whole.column(name).to_numpy() == v))) for v in sorted(set(whole.column(name).to_pylist()))}

    def notes(parts):
        found = of(list(parts.values()), "block", lambda t: t)
        return [found.get(b, none) for b in range(len(blocks))]

    shared = notes(of([passages._hashes(b, none, ranges) for b in blocks], "range", passages._shared))
    found = notes(of([passages._stretches(b, n, ranges) for b, n in zip(blocks, shared, strict=True)], "range", passages._repeated))
    kept = [passages._kept(b, n).to_pylist()[0] for b, n in zip(blocks, found, strict=True)]
    return [(r["id"], [(s["start"], s["end"]) for s in r["spans"]]) for r in kept]


def test_what_shares_only_a_hash_meets_no_transform(monkeypatch):
    rnd = random.Random(3)
    letters = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    phrase, passage = letters(24), letters(90)
    rows = [(i, letters(200) + phrase + letters(200)) for i in range(40)]
    rows += [(i, letters(60) + passage + letters(60)) for i in (41, 42)]
    seen, run = [], passages.smallest_ids
    monkeypatch.setattr(passages, "smallest_ids", lambda data, *x: (seen.append(len(data)), run(data, *x))[1])
    want = [(i, spans(g)) for i, _, g in brute(rows)]
    assert stepped(rows) == want and sum(len(s) for _, s in want) == 1
    # the passage's own stretches only: the phrase's would be 40 times 50 bytes at least
    assert 0 < sum(seen) < 2000


def test_common_strings_in_one_document_meet_no_transform(monkeypatch):
    monkeypatch.setattr(passages, "COMMON", 2)
    rnd = random.Random(4)
    letters = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    passage = letters(90)
    rows = [(i, letters(60) + passage + letters(60)) for i in rnd.sample(range(100), 30)]
    seen, run = [], passages.smallest_ids
    monkeypatch.setattr(passages, "smallest_ids", lambda data, *x: (seen.append(len(data)), run(data, *x))[1])
    want = [(i, spans(g)) for i, _, g in brute(rows)]
    assert stepped(rows) == want
    # 41 strings of the passage, and a few that chance makes longer; those over its edges are in one document
    assert 0 < sum(seen) < 90 * 51


def test_equal_strings_hold_their_substring_at_one_place():
    rnd = np.random.default_rng(5)
    data = rnd.integers(97, 123, 140_000).astype(np.uint8)
    for period in (1, 2, 17, 30):
        again = np.resize(rnd.integers(97, 123, period), 240).astype(np.uint8)
        for place in (1000, 65536 - 120, 131072 - 90):
            data[place : place + 240] = again
        first, counts, h, spot, _ = passages.minima(data, np.ones(len(data), bool))
        text, at = data.tobytes(), {}
        assert first[0] == 0 and counts.sum() == len(data) - K + 1
        for a, n, x, p in zip(first.tolist(), counts.tolist(), h.tolist(), spot.tolist(), strict=True):
            for j in range(n):
                assert 0 <= p - j <= K - passages.M
                assert at.setdefault(text[a + j : a + j + K], (x, p - j)) == (x, p - j)
