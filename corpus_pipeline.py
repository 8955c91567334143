"""The corpus pipeline: five stages, each one of the operators of linkspark.llm.

A stage takes (spark, docs, sf_dir) and returns a frame, which the caller may write
and read again before the next. All but the last return the columns of documents, and
any more that they had, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import language, mixing, neardup, pieces, secrets
from linkspark.llm.common import drop, new_path


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejected documents, and those without a letter, go; so do null and
    empty texts. Repeated rows are judged alike, and stay or go together; a null id or
    language is no obstacle, and very long texts are read whole."""
    found = language.predict(docs, language.train(docs), keep=True)
    return found.where("accepted").select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group the document with the smallest id stays. Of
    repeated rows, and of equal ids and texts, one stays; a null id is the last of a
    group; texts without a word, null ones among them, are equal if their text is, and
    like no other."""
    return neardup.first_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every secret is masked in its text, and n_chars follows, where it
    is not null. Every row stays, repeated ones too; a null or empty text holds nothing."""
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(masked.schema["n_chars"].dataType)))


def by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as the mix takes it,
    which may be never. A null source is a source of its own, the last; a document
    without a word, a null text among them, has no size and is not taken; repeated rows
    and equal ids are ordered by a hash of id and text, and all count."""
    return mixing.mixed(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding: ids, the bytes they stand for, and whether
    they decode to the text they came from. A null text counts as empty, which has no
    ids; every row gives a row, whatever its id."""
    import public_tokenizers

    return pieces.encode_checked(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", by_language),
    ("MinHash near-dedup", without_copies),
    ("secret scans", without_secrets),
    ("mixing sources", by_source),
    ("SentencePiece", as_pieces),
]

#: Models and hash signatures decide most stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. A
    stage's table goes once the next one is written; the last one is what the result
    reads, and stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            at = new_path(spark, "pipeline")
            docs.write.parquet(at)
            if before is not None:
                drop(spark, before)
            docs, before = spark.read.parquet(at), at
    return docs
