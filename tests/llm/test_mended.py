"""Forms and sizes that earlier versions of the operators missed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.llm import language, licenses, neardup, neighbours, quality

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


@pytest.mark.parametrize(
    "head",
    ["MIT License\n\nCopyright (c) 2020 Someone\n\n", "The MIT License (MIT)\n\nCopyright © Foo\n\n", "Copyright Foo, Inc. and other contributors\n\n", "\n# MIT License\n\n", "The MIT License\n===============\nCopyright JS Foundation and other contributors\nAll rights reserved.\n\n", ""],
)
def test_licence_under_its_head(spark, head):
    rows = [(1, head + MIT), (2, head + MIT.replace("Software", "Work")), (3, head + "My license\n")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: None, 3: None}


def test_bsd_under_its_title(spark):
    text = next(t for n, t in licenses.TEXTS if n == "BSD-3-Clause")
    df = spark.createDataFrame([(1, "BSD 3-Clause License\n\nCopyright (c) 2019, A\nAll rights reserved.\n\n" + text)], "doc_id long, text string")
    assert licenses.scan(df).first()["license"] == "BSD-3-Clause"


def test_languages_of_long_texts_are_learned(spark):
    one, two = "ka lo mi ba tu ", "xefre gond wirp sklit "
    rows = [(i, one * 4400, "xx", "s") for i in range(20)] + [(100 + i, two * 12, "yy", "s") for i in range(20)] + [(300 + i, one * 20, "xx", "s") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(df, language.train(df)).collect()}
    assert got == {r[0]: r[2] for r in rows}


@pytest.mark.parametrize("end", [".", "।", "؟", "！", "。", "።", "۔", "?»"])
def test_lines_of_prose_in_every_script(spark, end):
    line = lambda i: " ".join(f"{chr(97 + i)}{chr(97 + j)}" for j in range(13))
    rows = [(1, "\n".join(line(i) + end for i in range(12))), (2, "\n".join(line(i) for i in range(12)))]
    got = {r["doc_id"]: (r["kept"], r["kept_words"]) for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (True, 156), 2: (False, 0)}


def test_components_at_the_ends_of_the_range(spark):
    rows = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (50, [1e-200, 1e-200]), (51, [5e-324, 0.0])]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in found.collect()}
    assert len(got) == 8 and got[0, 1] == pytest.approx(1.0) and got[50, 0] == pytest.approx(1.0) and got[0, 2] == pytest.approx(0.0, abs=1e-15)


def test_search_is_exact_where_no_number_of_visits_suffices(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST", 1)
    monkeypatch.setattr(neighbours, "TABLES", 1)
    monkeypatch.setattr(neighbours, "RECALL", 1.0)
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    hashing, visits = neighbours.fit(neighbours.valid(df, "vec_id", "embedding"), neighbours.valid(df.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding"), 5, 8, 400)
    assert (hashing.projections, visits) == (0, 1)
    cells = hashing.cells(vectors)
    assert cells.shape == (1, 400) and len(np.unique(cells)) == 1 and (hashing.visits(vectors[:3], visits)[0] == cells[0, 0]).all()


def test_a_bitmap_loses_no_node(spark):
    nodes = [0, 1, -1, 2**63 - 1, -(2**63), neardup.SLOTS, -neardup.SLOTS, 32768, 32769, 123456789012345]
    df = spark.createDataFrame([(n, "t") for n in nodes], "node long, t string")
    everything = df.union(spark.range(5000).select(F.xxhash64("id").alias("node"), F.lit("x").alias("t")))
    got = [r["node"] for r in neardup.among(everything, df).collect()]
    assert set(nodes) <= set(got) and len(got) < len(nodes) + 20
    assert neardup.among(everything, df.limit(0)).count() == 0


def test_few_links_are_few_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(2**40), 2**40, (400, 2))]
    pairs += [(i, i + 1) for i in range(0, 90)] + [(-7, -1000 - i) for i in range(300)] + [(a, b + 1) for (a, _), (b, _) in zip(pairs[:50], pairs[50:100], strict=True)]
    smallest: dict[int, int] = {x: x for p in pairs for x in p}
    while any(smallest[a] != smallest[b] for a, b in pairs):
        for a, b in pairs:
            smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    links = spark.createDataFrame(pairs, "a long, b long").repartition(12)
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(key, value)
    try:
        few = neardup.components(links)
        assert few.rdd.getNumPartitions() == 1
        assert {r["node"]: r["label"] for r in few.collect()} == smallest
        monkeypatch.setattr(neardup, "LINKS", 250)
        more = neardup.components(links)
        assert 1 < more.rdd.getNumPartitions() < 16
        assert {r["node"]: r["label"] for r in more.collect()} == smallest
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
