"""Pages and ranks by counts of ranges, against plain sorting."""

import datetime
import random

import pytest

from linkspark.operators import order as O
from linkspark.operators import scoring


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    day = datetime.datetime(2024, 1, 1)
    # a third of all rows at one moment, some without one
    when = [day + datetime.timedelta(hours=3) if i % 3 == 0 else None if i % 50 == 1 else day + datetime.timedelta(seconds=rnd.randint(0, 9999)) for i in range(6000)]
    return list(zip(when, rnd.sample([f"t{i:05d}" for i in range(6000)], 6000), strict=True))


@pytest.mark.parametrize("descending", [True, False])
def test_pages(spark, rows, monkeypatch, descending):
    monkeypatch.setattr(O, "FEW", 150)
    monkeypatch.setattr(O, "RANGES", 8)
    df = spark.createDataFrame(rows, "d timestamp, id string").repartition(5)
    ranked = sorted(rows, key=lambda r: (r[0] is not None, r[0] or datetime.datetime.min, r[1]), reverse=descending)
    for offset, limit in ((0, 7), (1990, 60), (5990, 50), (6000, 5), (3000, 1)):
        assert [tuple(r) for r in O.slice_of(df, ["d", "id"], offset, limit, descending).collect()] == ranked[offset : offset + limit]
    at = ranked[2500]
    assert [tuple(r) for r in O.after(df, ["d", "id"], {"d": at[0], "id": at[1]}, 9, descending).collect()] == ranked[2501:2510]


def test_rows_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(O, "FEW", 10)
    df = spark.createDataFrame([(1, "a")] * 90 + [(2, "b")], "d int, id string")
    assert [tuple(r) for r in O.slice_of(df, ["d", "id"], 0, 3).collect()] == [(2, "b"), (1, "a"), (1, "a")]
    assert O.slice_of(df, ["d", "id"], 89, 5).count() == 2
    assert O.slice_of(df.limit(0), ["d", "id"], 0, 5).count() == 0


def test_few_rows_are_sorted_for_a_far_page(spark):
    df = spark.range(1_200_000).selectExpr("id % 1000 as d", "cast(id as string) as id")
    page = O.slice_of(df, ["d", "id"], 1_000_000, 50)
    got = [tuple(r) for r in page.collect()]
    want = sorted(((i % 1000, str(i)) for i in range(1_200_000)), reverse=True)[1_000_000:1_000_050]
    assert got == want
    limit = page._jdf.queryExecution().optimizedPlan().toString()
    assert int(limit.split("LocalLimit ")[1].split()[0].split("\n")[0]) < 150_000


def test_ranks_with_a_third_of_all_values_equal(spark):
    rnd = random.Random(9)
    own = [(f"k{i}", "m", 5.0 if i % 3 == 0 else round(rnd.uniform(0, 9), 1)) for i in range(3000)] + [("z", "m", 0.0), ("y", "other", 1.0)]
    norms = [("m", v, 1) for _, m, v in own if m == "m" and v > 0] + [("m", 100.0, 4)]
    got = {r["key"]: r["rank"] for r in scoring.pct_ranks(spark.createDataFrame(own, "key string, measure string, value double"), spark.createDataFrame(norms, "measure string, value double, n long")).collect()}
    total = sum(n for *_, n in norms)
    upto = {v: sum(n for _, x, n in norms if x <= v) / total for v in {v for _, m, v in own if m == "m"}}
    assert got == {k: 0.0 if m == "other" or not v else upto[v] for k, m, v in own}
