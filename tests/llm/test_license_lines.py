"""Notices of one line, however their words are spaced."""

import pytest

from linkspark.llm import licenses


@pytest.mark.parametrize("gap", [" ", "-", "  ", "\t", "\u00a0", " - "])
def test_public_domain_line(spark, gap):
    df = spark.createDataFrame([(1, f"x\nDedicated to the public{gap}domain under CC0 1.0.\ny")], "doc_id long, text string")
    assert [(r["n_notices"], r["notices"]) for r in licenses.scan(df).collect()] == [(1, "CC0-1.0")]


def test_the_line_filter_passes_every_known_notice():
    lines = [text.lower() for _, text in licenses.KNOWN if "\n" not in text]
    assert all("licen" in t or ("public" in t and "domain" in t) for t in lines)


def test_spacing_tags_and_headers(spark):
    texts = [
        "x\nDedicated to the public-domain under CC0 1.0.\ny",
        "Dedicated to the public  domain under CC0 1.0.",
        "Dedicated to the public\tdomain under CC0 1.0!",
        "# SPDX-License-Identifier: Apache-2.0",
        "Distributed under the MIT Licence",
        licenses._GNU.format(name="GNU General Public License", n="3").upper(),
        "Copyright 2020 A\n(c) 2021 B\nReleased under the MIT License.\n" + "word " * 50_000,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["license"], r["n_notices"], r["notices"]) for r in licenses.scan(df).collect())
    cc0 = (None, 1, "CC0-1.0")
    assert got[:2] == [(0, *cc0), (0, *cc0)] and [g[2:] for g in got[2:]] == [(1, "CC0-1.0"), (1, "CC0-1.0"), (1, "Apache-2.0"), (1, "MIT"), (0, ""), (1, "MIT")]
    assert {g[0]: g[1] for g in got}[5] == "GPL-3-or-later"
