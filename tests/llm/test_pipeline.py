from __future__ import annotations

import corpus_pipeline
from textmill.llm import queries


def test_stages_keep_the_columns_and_run_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns and docs.count(), name
    want = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, label string, d string, x string, row string, mark string, key string, n string, id string, first string"


def odd(spark):
    line = " ".join(f"word{i}" for i in range(30))
    texts = [(1, "A clean text that nothing else repeats."), (2, line + "\nown words of two"), (3, "other start\n" + line), (4, None), (5, ""), (6, " \n"), (7, "quite another text for the seventh row"), (7, "and one more text under the same number"), (8, "said twice in one row"), (8, "said twice in one row"), (None, "no number here"), (9, "long " * 60_000)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["c"] * 9) for i, t in texts], ODD).repartition(3)


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty, blank and very long texts, repeated rows and ids, and columns named like the operators' own."""
    docs = odd(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert after.columns == docs.columns
        kept[name] = sorted(((r.doc_id, r.text, r.n_chars) for r in after.collect()), key=str)
        docs = after
    texts = {name: {(i, t) for i, t, _ in rows} for name, rows in kept.items()}
    assert len(kept["toxicity"]) == len(kept["line_dedup"]) == 12
    assert all(n == len(t or "") for i, t, n in kept["line_dedup"] if t is not None) and (4, None) in texts["line_dedup"]
    assert (2, " ".join(f"word{i}" for i in range(30)) + "\nown words of two") in texts["line_dedup"] and not any(t and "word29" in t for i, t in texts["line_dedup"] if i == 3)
    last = texts["simhash_near_dedup"]
    assert {(1, "A clean text that nothing else repeats."), (7, "quite another text for the seventh row"), (7, "and one more text under the same number"), (8, "said twice in one row"), (None, "no number here")} <= last
    assert len([1 for i, t in last if not (t or "").strip()]) == 1 and len(kept["simhash_near_dedup"]) == len(last)
    assert kept["decontamination"] == kept["simhash_near_dedup"]
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert tokens.count() == docs.count()


def test_stages_on_an_empty_table(spark, sf):
    docs = odd(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    assert docs.count() == 0 and corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0


def test_all_queries_are_registered():
    names = set(queries.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.partition("_")[0] for n in names if n.startswith("op")} and "pipeline" in names


def test_decontamination_against_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = set(c.sql(queries.OP7_SQL).fetchall())
    assert {tuple(r) for r in queries.op7_decontamination(spark, sf).collect()} == want and want
