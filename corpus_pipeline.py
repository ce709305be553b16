"""From ``documents`` to token identifiers: language, repeated lines, near copies, benchmark items, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm import byte_bpe, decontaminate, jaccard_join, language_id, line_dedup
from tracelane.llm.common import Scratch, read_table

def _as_before(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in their order."""
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is mostly in one language that the labelled documents teach; undetermined ones go.

    Null, empty and letterless texts are undetermined. Rows without a language teach nothing but are judged like all
    others. Equal rows stay or go together, other columns pass through, and an empty table stays empty.
    """
    model = language_id.learn(docs)
    return _as_before(language_id.accept(language_id.identify(docs, model)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has are taken out; documents of which nothing but white space is left go.

    Null and empty texts go with them. Rows that share an identifier, null ones too, are one document and keep their
    lines. ``n_chars``, if there, is counted again; other columns pass through, and an empty table stays empty.
    """
    kept = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return _as_before(kept.where(F.col("text").rlike(r"\S")), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, that of the smallest identifier.

    Texts without a word link to nothing and stay. A null identifier is the largest; rows of the kept identifier all
    stay. Other columns pass through, and an empty table stays empty.
    """
    return _as_before(jaccard_join.keep_one(docs), docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text.

    Null and empty texts stay, null and blank items are found nowhere, and equal rows go together. Other columns pass
    through; an empty table stays empty.
    """
    return _as_before(decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark")), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of each document, and the digests that show that decoding gives the text back.

    A row per input row; null text counts as empty and is told as not lossless (null). Other columns are not read.
    """
    coded = byte_bpe.round_trip(docs.select("doc_id", "text"))
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text").cast("binary")).alias("lossless"), "token_ids")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("encoding", encoding)]

#: SQL can express neither the language model nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables between stages go to the folder that driver and executors share."""
    scratch = Scratch(spark, "corpus_pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
