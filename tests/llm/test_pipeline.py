"""The pipeline's stages in turn, each against what its operator decides."""

from pyspark.sql import functions as F

import corpus_pipeline
from linkspark.llm import mixing, neardup


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns
        if k == 1:
            kept = {r["class_id"] for r in neardup.near_duplicates(docs).collect()}
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(kept)
        if k == 2:
            assert out.count() == docs.count() and not out.where(F.col("text").rlike("[0-9a-f]{24}")).count()
        if k == 3:
            assert out.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]
        if k == 4:
            assert out.count() == docs.count() and not out.where("not decodes").count()
        docs = out
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == docs.count()


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, node string, k int, t string, size int, part long, row string, band long, _n int"


def edges(spark):
    text = "der hund geht in den wald und die katze schläft auf dem dach " * 3
    rows = [(None, None), (None, ""), (3, " \n\t"), (4, text), (4, text), (5, text), (6, text + "token=abcdefg123"), (None, text), (7, "ein ganz anderer langer text " * 4000), (8, "x")]
    return spark.createDataFrame([(i, t, "de" if k % 2 else None, None if k % 3 else "s", None if t is None else len(t), "n", 1, "t", 2, 3, "r", 4, 5) for k, (i, t) in enumerate(rows)], CLASHING)


def test_stages_on_edges(spark):
    docs = edges(spark)
    out = {name: stage(spark, docs, "") for name, stage in corpus_pipeline.STAGES}
    rows = {name: df.collect() for name, df in out.items()}
    said = {name: [(r["doc_id"], r["text"]) for r in rows[name]] for name in [*out][:4]}
    for name in said:
        assert out[name].columns == docs.columns
    assert not {(None, None), (None, ""), (3, " \n\t")} & {*said["language ID"]}
    assert sum(i == 4 for i, _ in said["language ID"]) in (0, 2)
    dedup = said["MinHash near-dedup"]
    assert [i for i, t in dedup if t and t.startswith("der hund")] == [4] and (8, "x") in dedup and sum(i == 7 for i, _ in dedup) == 1
    masked = said["secret scans"]
    assert len(masked) == 10 and not any("abcdefg123" in (t or "") for _, t in masked) and sum(t is None for _, t in masked) == 1
    mixed = said["mixing sources"]
    assert len(mixed) == mixing.mix(docs).agg(F.sum("copies")).first()[0] and all((t or "").strip() for _, t in mixed)
    assert len(rows["SentencePiece"]) == 10 and all(r["decodes"] for r in rows["SentencePiece"])


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edges(spark).limit(0), "").count() == 0
