"""Queries on odd texts, and on whole tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.operators import dedup
from textmill.operators.ingest import Corpus
from textmill.plans.catalog import ORACLES, QUERIES
from textmill.storage import Store


def sql_rows(name, **tables):
    c = duckdb.connect()
    for table, path in tables.items():
        c.sql(f"create view {table} as select * from read_parquet('{path}/*.parquet')")
    rel = c.sql(ORACLES[name])
    return rel.columns, rel.fetchall()


def both(spark, folder, name, table, df):
    """Rows of a query over one table, in Spark and in SQL."""
    df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    columns, want = sql_rows(name, **{table: f"{folder}/{table}.parquet"})
    got = QUERIES[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(str, map(tuple, got))), sorted(map(str, want))


BLANKS = [*map(chr, (9, 11, 12, 13, 28, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))]


def test_squeezed_text_of_odd_texts(spark, tmp_path):
    """SQL's trim takes all Unicode spaces, and no line at all is NULL."""
    texts = [None, "", " ", "\n\n", "\t\r\n \r", "　", "　\n \nb"]
    for b in BLANKS:
        texts += [b, f"{b}a{b}", f"a{b}\n{b}b", f" {b} a {b}{b} c\t{b} \r{b}\r\n{b}é😀", f"a{b}b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = both(spark, tmp_path, "squeezed_text", "documents", df)
    assert got == want


@pytest.mark.parametrize("ids", [range(1, 45), [50, 51, 52, 101]])
def test_cosine_pairs_takes_every_vector(spark, tmp_path, ids):
    rows = [(i, [float((i * j) % 7 - 3) + 0.5 for j in range(1, 5)], i % 3) for i in ids]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got, want = both(spark, tmp_path, "cosine_pairs", "embeddings", df)
    assert got == want and len({x.split(",")[0] for x in got}) == len(rows)


def test_mined_cases_of_odd_texts(spark, tmp_path):
    """Chosen in one reading of a text: the tie, the penalty, inner words, and words beyond those that count are SQL's."""
    words = "alpha alphabet beta_gamma delta-ray gammon 12345 epsilon zeta theta iotas kappa lambda omicron sigma upsilon omega random words without meaning are here again".split()
    r = random.Random(5)
    texts = [None, "", " ", "...", "alphabet soup for everyone here today.", "a b c d e f g h i j k l m n o p."]
    for _ in range(150):
        parts = [" ".join(r.choices(words, k=r.choice([2, 5, 8, 12, 20, 40, 110, 130]))) for _ in range(r.randint(1, 6))]
        texts.append("".join(r.choice(["", "\x0b", " ", "\t", " "]) + p + r.choice([". ", "!", "？", "\n", ";\x0b", "\x01", ". ", ".\u0085"]) for p in parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = both(spark, tmp_path, "mined_cases", "documents", df)
    assert got == want and len(got) > 100
    plan = QUERIES["mined_cases"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "posexplode" not in plan


def test_fingerprints_are_those_of_all_grams(spark, monkeypatch):
    """Against a plain SimHash over ``tx.grams``: odd texts, several rows of an id, small runs; no row per gram is made."""
    r = random.Random(3)
    words = ["alpha", "Élan", "内存管理系统", "x", "é", "ab", "été", "a_b1", "😀", "Straße", "12", "naïve"]
    rows = [(0, None), (1, ""), (2, "—"), (3, "a"), (4, "alpha " * 70_000)] + [(5 + i // 2, " ".join(r.choices(words, k=r.randint(1, 400)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sums = {}
    for doc, g in df.select("doc_id", tx.grams(F.col("text"))).collect():
        own = sums.setdefault(doc, [0] * 64)
        for gram, times in Counter(g or []).items():
            v = int(hashlib.md5(gram.encode()).hexdigest()[:16], 16)
            for i in range(64):
                own[i] += times if v >> i & 1 else -times
    signed = lambda own: sum((x > 0) << i for i, x in enumerate(own)) - ((own[63] > 0) << 64)
    got = dedup.md5_simhash(df)
    assert {x.doc_id: x.fp for x in got.collect()} == {k: signed(v) for k, v in sums.items()}
    assert "MapInArrow" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Generate" not in plan
    one = {x.doc_id: x.fp for x in dedup.row_simhash(df.filter("doc_id < 5"), "doc_id").collect()}
    assert one == {k: signed(sums[k]) for k in range(5)}


def test_ingest_leaves_no_copies_of_texts(spark, tmp_path):
    """Texts are in the store once as texts and once as sections; what was between goes with the batch."""
    size = lambda at: sum(f.stat().st_size for f in Path(at).rglob("*") if f.is_file()) if Path(at).exists() else 0
    r = random.Random(8)
    rows = [(i, "\n".join(f"{r.getrandbits(2000):x}." for _ in range(20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = spark.sparkContext.getCheckpointDir() or "/tmp/textmill-tests"
    before = size(folder.removeprefix("file:"))
    corpus = Corpus(Store(spark, str(tmp_path / "corpus")))
    corpus.ingest("a", docs)
    assert size(folder.removeprefix("file:")) - before < sum(len(t) for _, t in rows) // 2
    assert size(tmp_path / "corpus" / "scratch") == 0 and corpus.documents().count() == 60
