"""Sources and sinks over files: corpora, images, logs, datasets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of texts and images, and names that are no documents.
TEXT_SUFFIXES = ("md", "markdown", "txt", "rst", "csv", "log")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp", "gif")
SKIPPED_STEMS = ("readme", "index", "说明")

CASE = "case_id string, question string, tags array<string>, expected_sources array<string>, expected_keywords array<string>, gold_snippets array<string>, forbidden_keywords array<string>, allow_unknown boolean, notes string"
OBSERVATION = "case_id string, question string, outcome string, answer string, retrieved_sources array<string>, latency_ms double, answer_support_rate double, error_code string, failed boolean, meta string, recorded_at double"
CHECKPOINT = "schema_version int, run_id string, step int, label string, created_at double, state string"
MULTIHOP = "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<title: string, paragraph_text: string, is_supporting: boolean>>"


def scan_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(texts: name, text) and (skipped: name, reason) of a folder. Bytes that are no UTF-8 are replaced; nothing aborts the scan. Files of no bytes hold no document and are passed over."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    stem, suffix = F.lower(F.regexp_replace("name", r"\.[^.]*$", "")), F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    reason = F.when(stem.isin(*SKIPPED_STEMS), "not a document").when(suffix.isin(*IMAGE_SUFFIXES), "needs an extractor").when(~suffix.isin(*TEXT_SUFFIXES), "unknown suffix")
    marked = files.withColumn("reason", reason)

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return marked.filter("reason is null").select("name", text("content").alias("text")), marked.filter("reason is not null").select("name", "reason")


def extract_images(spark: SparkSession, folder: str, extractor: Callable[[str, bytes], str], max_chars: int = 20_000) -> DataFrame:
    """(name, text, error) of images by an extractor that is passed in; a failure is a row's error, never the job's."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    files = files.filter(F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(*IMAGE_SUFFIXES))

    @F.pandas_udf("text string, error string")
    def run(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for n, c in zip(names, contents):
            try:
                t = extractor(n, bytes(c))[:max_chars]
                rows.append((t, None if t.strip() else "empty"))
            except Exception as e:  # noqa: BLE001  an extractor may raise anything
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    return files.select("name", run("name", "content").alias("r")).select("name", "r.*")


def read_log(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """Rows of a JSON-lines log; damaged lines and other schema versions are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.col("schema_version") == version) if version is not None else rows


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines with the time of writing."""
    rows.withColumn("recorded_at", F.unix_micros(F.current_timestamp()) / 1e6).write.mode("append").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON array; ValueError names up to 20 problems."""
    cases = spark.read.schema(CASE).option("multiLine", True).json(path)
    twice = cases.groupBy("case_id").count().filter("count > 1").select(F.concat(F.lit("repeated id: "), "case_id").alias("p"))
    empty = cases.filter("case_id is null or coalesce(trim(question), '') = ''").select(F.concat(F.lit("no question: "), F.coalesce("case_id", F.lit("?"))).alias("p"))
    bad = [r.p for r in twice.union(empty).limit(20).collect()]
    if bad:
        raise ValueError("; ".join(bad))
    return cases


def read_multihop(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases: id, question, answers, gold titles) and (corpus: title, text) of multi-hop samples; a paragraph that several samples share counts once."""
    raw = spark.read.schema(MULTIHOP).json(path)
    gold = F.transform(F.filter("paragraphs", lambda p: p.is_supporting), lambda p: p.title)
    cases = raw.select("id", "question", F.array_union(F.array("answer"), F.coalesce("answer_aliases", F.array())).alias("answers"), gold.alias("gold"))
    corpus = raw.select(F.explode("paragraphs").alias("p")).select(F.col("p.title").alias("title"), F.col("p.paragraph_text").alias("text")).distinct()
    return cases, corpus


def write_preferences(pairs: DataFrame, path: str) -> None:
    """Preference pairs as JSON lines, without empty and equal ones."""
    pairs.filter("chosen <> '' and rejected <> '' and chosen <> rejected").write.mode("overwrite").json(path)


def report(title: str, table: DataFrame, rows: int = 100) -> str:
    """A Markdown table of a small result."""
    lines = [f"# {title}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    show = lambda v: "–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in table.limit(rows).collect()]) + "\n"
