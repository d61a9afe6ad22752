"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and is written as Parquet before the next one starts. All but the last
return the columns of ``documents``, whatever other columns these have. Rows
that repeat an id are decided by their texts; no stage drops a row for a null
id, and an empty table passes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.decontaminate import drop_contaminated
from textmill.llm.line_dedup import drop_repeated_lines
from textmill.llm.pieces import piece_ids
from textmill.llm.shared import written
from textmill.llm.simhash import drop_near_duplicates
from textmill.llm.toxicity import drop_toxic, learn_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those that score 0.5 or more. Null and empty texts score as texts without hits; repeated rows go or stay together."""
    return drop_toxic(docs, learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines, also of passages pasted into lines; n_chars, if there is one, follows the text.

    Every row stays: its text is empty if all of it went, and null if it was. The first of equal runs is that of the least id, null ids first; repeated rows are treated alike.
    """
    kept = drop_repeated_lines(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies, null ids last. Null, empty and blank texts are one group; of repeated rows one stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item. Null and empty texts contain none; items without words are contained in none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left: their number and digests, a row for each document; null and empty texts have no ids."""
    return piece_ids(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", tokenisation)]

#: No stage but decontamination can be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
