"""A corpus pipeline of five stages, each one operator: what a stage decides, the next one works on.

Language ID drops documents whose language cannot be told and sets ``lang`` to the language found; line dedup takes lines
out of the texts; SimHash near-dedup keeps one document of each group; mixing repeats or leaves out documents so that the
sources have equal weights; SentencePiece encodes each text with merge-dropout, each copy by its own draws, and decodes it
again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import langid, line_dedup, mixing, simhash, sp_dropout
from strandloom.llm.common import save, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    profiles = langid.fit(docs)
    found = langid.predict(docs.select(*COLUMNS), profiles, into=("_lang", "_score"))
    return found.where(F.col("_lang") != langid.UNKNOWN).withColumn("lang", F.col("_lang")).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.keep_one(docs.select(*COLUMNS))


def source_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture, with the number of each copy for the draws of the last stage."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS, "copy")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_copies(spark, docs, sf_dir).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    copy = "copy" if "copy" in docs.columns else None
    out = sp_dropout.decode(sp_dropout.encode(docs.select("doc_id", "text", "lang", "source", *[copy] * bool(copy)), copy_col=copy))
    return out.select(
        "doc_id", "lang", "source",
        sp_dropout.n_pieces(F.col("pieces")).alias("n_pieces"),
        F.sha2("pieces", 256).alias("pieces_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_dedup),
    ("mixing", source_copies),
    ("SentencePiece", sentencepiece),
]

#: Profiles, components and dropout are not to be expressed in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs)
    return docs
