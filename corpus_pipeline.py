"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, SentencePiece pieces.

Every stage takes whole tables. In all of them repeated rows are rows of their own unless said otherwise, columns of any other name go
through untouched, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quietcount.llm import decontamination, line_dedup, minhash_dedup, pieces, quality
from quietcount.llm.kernel import folder, remove


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model rejects go. A null or empty text is one empty line and judged as that; a score of one half
    stays; repeated rows are judged alike; without labels all stay. Long texts are scored whole."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines stay in the first document that has them; n_chars follows the text. No row goes. A null text stays null; a
    null source is no site; rows that share id and text lose the same lines; long texts are judged line by line, whole."""
    return line_dedup.clean_lines(docs)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of smallest id, with all its repeated rows. Null and empty texts
    are one class; a null id stays only in a class without any other; long texts are weighed whole."""
    return minhash_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go. A text without words, null or empty, holds none and stays; repeated rows are judged
    alike; long texts are matched whole; an empty benchmark lets all stay."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their sampled pieces and how many those are. A null or empty text has none; a null id counts as 0; rows of
    equal id and text get equal pieces; long texts are encoded whole. Columns called pieces or n_pieces are replaced."""
    return pieces.encode_stage(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", minhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The trained field, sampled signatures and sampled pieces have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage is written to the shared folder as Parquet and read again as the next one's documents; a stage's table goes as soon as
    the next one is written, the last when the driver ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
