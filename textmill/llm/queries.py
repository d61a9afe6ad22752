"""Queries of the operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.chat_windows import chat_digests, chat_windows
from textmill.llm.decontaminate import contained_items
from textmill.llm.fim import fill_in_middle, fim_digests
from textmill.llm.licenses import license_table
from textmill.llm.line_dedup import drop_repeated_lines
from textmill.llm.matroska import media_column, media_digests
from textmill.llm.pieces import piece_ids
from textmill.llm.pii import pii_table
from textmill.llm.shared import written
from textmill.llm.simhash import simhash_components
from textmill.llm.token_records import read_token_records, write_token_records
from textmill.llm.toxicity import learn_toxicity, score_toxicity
from textmill.llm.warc import read_archives, write_archives
from textmill.llm.whitening import whitening_table

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at two or fewer differing bits."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as binary token records, read back."""
    return read_token_records(write_token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents name or quote."""
    return license_table(table(spark, sf_dir, "documents"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as dictionary-compressed WARC records, read back."""
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("payload")


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Matroska media, parsed and read back."""
    return media_digests(media_column(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents."""
    return pii_table(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs: what went, and a digest of what stays."""
    got = drop_repeated_lines(table(spark, sf_dir, "documents"), counts=True)
    return got.select("doc_id", "removed_runs", "removed_words", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pieces, and decoded again."""
    return piece_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: A conversation whose texts are control strings.
ODD_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in budgeted windows, written and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(ODD_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat_digests(written(chat_windows(turns.unionByName(odd)), "windows"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a middle to fill in, rebuilt from the outputs."""
    return fim_digests(*fill_in_middle(table(spark, sf_dir, "documents")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on their eight principal components, whitened."""
    got = whitening_table(table(spark, sf_dir, "embeddings"))
    return got.withColumn("deviation", F.col("deviation").cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    """All queries of this subpackage by name."""
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_token_records, op3_toxicity, op4_license_scan, op5_warc_archive, op6_matroska, op7_decontamination, op8_pii, op9_line_dedup, op10_sentencepiece, op11_chat_windows, op12_fill_in_middle, op13_embedding_whitening, pipeline)}


#: Exact containment by brute force: every distinct shingle of an item against every distinct shingle of a document.
OP7_SQL = r"""
with d as (select doc_id, regexp_extract_all(regexp_replace(lower(text), '\p{Cf}', '', 'g'), '[\p{L}\p{M}\p{N}]+') as w from documents),
b as (select item_id, regexp_extract_all(regexp_replace(lower(text), '\p{Cf}', '', 'g'), '[\p{L}\p{M}\p{N}]+') as w from benchmark),
items as (select item_id, w, least(5, len(w)) as k from b where len(w) > 0),
own as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as s from (select item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from items)),
sizes as (select item_id, count(*) as n from own group by item_id),
lengths as (select distinct k from items),
has as (select distinct doc_id, k, array_to_string(w[i : i + k - 1], ' ') as s from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from d, lengths where len(w) >= k))
select doc_id, item_id, count(*)::bigint as n_common, any_value(n)::bigint as n_shingles
from own join has using (k, s) join sizes using (item_id)
group by doc_id, item_id having count(*) >= 0.8 * any_value(n) - 1e-9
"""


#: Lines, cuts and forms by their definition.
OP12_SQL = """
with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id) as h from documents),
u as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as lines from d),
c as (select *, len(lines) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[25:32])::bigint as h4 from u),
s as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b, text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') as plain from c),
p as (select *, array_to_string(lines[1 : a], '') as pre, array_to_string(lines[a + 1 : b], '') as mid, array_to_string(lines[b + 1 :], '') as suf, case when plain then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from s)
select doc_id, n::bigint as n, form, case when not plain then length(pre)::bigint end as prefix_chars, case when not plain then length(mid)::bigint end as middle_chars,
sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256 from p
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express."""
    return {"op7_decontamination": OP7_SQL, "op12_fill_in_middle": OP12_SQL}
