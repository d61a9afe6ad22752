"""Stored indexes: versions, idempotent adds, searches against the plain forms."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from textmill.operators import ann, dense, lexical
from textmill.operators.ann import VectorIndex
from textmill.operators.lexical_index import LexicalIndex
from textmill.plans.registry import Tables
from textmill.storage import Conflict, Manifest, Store


@pytest.fixture
def store(spark):
    return Store(spark, f"/tmp/textmill-tests/store-{uuid.uuid4().hex}")


def test_versions_of_tables(spark, store):
    assert store.version() == 0 and store.manifest() == Manifest()
    one = store.commit(store.manifest(), {"a": spark.range(3)}, batch="b1", notes={"x": 1})
    two = store.commit(one, {"b": spark.range(2)}, {"a": spark.range(10, 12)}, batch="b2")
    assert (two.version, two.batches, two.notes) == (2, ["b1", "b2"], {"x": 1}) and store.manifest() == two
    assert sorted(r.id for r in store.read("a").collect()) == [0, 1, 2, 10, 11] and store.read("a", 1).count() == 3
    with pytest.raises(Conflict):
        store.commit(one, {"a": spark.range(1)})
    assert store.version() == 2 and store.read("a").count() == 5
    three = store.commit(two, {"a": spark.range(0)})
    assert three.version == 3 and store.read("a").count() == 0 and store.read("b").count() == 2
    with pytest.raises(KeyError):
        store.read("c")


def test_a_commit_that_fails_publishes_nothing(spark, store):
    one = store.commit(store.manifest(), {"a": spark.range(3)})
    with pytest.raises(Exception):
        store.commit(one, {"a": spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))})
    assert store.version() == 1 and store.read("a").count() == 3


DOCS = [(1, "red red green"), (2, "green blue"), (3, ""), (4, None), (5, "blue blue blue sky_high")]


def test_adding_twice_changes_nothing(spark, store):
    index, docs = LexicalIndex(store), spark.createDataFrame(DOCS, "doc_id long, text string")
    assert index.add(docs.filter("doc_id < 3")).version == 1
    assert index.add(docs.filter("doc_id < 3")).version == 1
    assert index.add(docs).version == 2 and index.add(docs).version == 2
    rows = lambda df: sorted(map(tuple, df.collect()))
    parts = rows(index.postings()), rows(index.frequency()), rows(index.stats()), rows(index.store.read("documents").select("doc_id", "dl"))
    index.rebuild(docs)
    assert parts == (rows(index.postings()), rows(index.frequency()), rows(index.stats()), rows(index.store.read("documents").select("doc_id", "dl")))
    assert rows(index.frequency()) == [("blue", 2), ("green", 2), ("red", 1), ("sky_high", 1)] and rows(index.store.read("documents").select("doc_id", "dl")) == [(1, 3), (2, 2), (3, 0), (4, 0), (5, 4)]


def test_scores_are_those_of_the_plain_search(spark, sf, store):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    terms = lexical.query_terms(items)
    assert terms.agg(F.sum("qtf")).first()[0] > 12 * items.count()  # whole passages
    index = LexicalIndex(store)
    index.rebuild(docs.filter("doc_id % 2 = 0"))
    index.add(docs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.bm25(terms)) == rows(lexical.bm25(terms, docs))
    plan = index.bm25(terms)._jdf.queryExecution().executedPlan().toString()
    assert "/documents.parquet" not in plan and "folder" in plan


def test_folders_follow_the_terms(spark, sf, store, monkeypatch):
    import textmill.operators.lexical_index as module

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(module, "FOLDER", 2000)
    index = LexicalIndex(store)
    assert index.rebuild(docs).notes["folders"] > 4
    term = docs.sparkSession.createDataFrame([(0, "the", 1)], "item_id long, term string, qtf long")
    want = lexical.postings(docs).filter("term = 'the'")
    assert sorted(map(tuple, index.of_terms(term).collect())) == sorted(map(tuple, want.select("doc_id", "term", "tf", "dl").collect()))


def test_the_index_of_a_table_is_built_once(spark, sf):
    a, b = Tables(spark, sf), Tables(spark, sf)
    assert a.index.store.root == b.index.store.root and a.index.store.version() == b.index.store.version() == 1
    assert b.index.add(b.documents).version == 1


def recall(found, exact):
    got = {(r.qid, r.id) for r in found}
    want = {(r.qid, r.vec_id) for r in exact}
    return len(got & want) / len(want)


@pytest.mark.parametrize("sf_dir,most", [("/root/testdata/sf0.01", 0.15), ("/root/testdata/sf0.1", 0.05)])
def test_recall_and_compared_pairs(spark, store, sf_dir, most):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q, n = v.filter("vec_id % 50 = 0"), v.count()
    index = VectorIndex(store)
    index.rebuild(v)
    found = index.search(q, 10).collect()
    per = {r.qid: (r.compared / n, r.probed / n) for r in found}
    share = sum(c for c, _ in per.values()) / len(per)
    print("recall", recall(found, dense.vector_top_k(q, v, 10).collect()), "compared", share, "probed", sum(p for _, p in per.values()) / len(per))
    assert recall(found, dense.vector_top_k(q, v, 10).collect()) >= 0.95 and share < most and len(per) == q.count()


def clustered(spark, n=4000, d=24):
    import numpy as np

    r = np.random.default_rng(7)
    centres = r.normal(size=(40, d))
    rows = centres[r.integers(0, 40, n)] + 0.05 * r.normal(size=(n, d))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")


def test_queries_choose_their_cells(spark, store):
    """Vectors in clusters: the bound leaves most cells unread and loses nothing."""
    v = clustered(spark)
    q, index = v.filter("vec_id % 50 = 0"), VectorIndex(store)
    index.rebuild(v, parts=8)
    found = index.search(q, 10).collect()
    assert recall(found, dense.vector_top_k(q, v, 10).collect()) >= 0.98
    assert sum(r.probed for r in found) / len(found) < 0.3 * 4000 and sum(r.compared for r in found) / len(found) < 0.1 * 4000


def test_adds_copies_and_odd_vectors(spark, store):
    v = clustered(spark, 600, 8)
    index = VectorIndex(store)
    odd = spark.createDataFrame([(9001, None), (9002, []), (9003, [float("nan")] * 8), (9004, [0.0] * 8), (9005, [1.0] * 3), (9006, [1.0, None] * 4)], v.schema)
    first = index.rebuild(v.unionByName(odd))
    assert index.store.read("vectors").count() == 600 and index.add(v.unionByName(odd)).version == first.version
    copies = spark.range(20_000, 20_900).withColumnRenamed("id", "vec_id").crossJoin(v.filter("vec_id = 7").select("embedding"))
    assert index.add(copies).version == 2 and index.add(copies).version == 2 and index.store.read("vectors").count() == 1500
    got = index.search(v.filter("vec_id in (7, 8)").unionByName(odd), 5).collect()
    assert [r.id for r in sorted(got, key=lambda r: (r.qid, r.rnk)) if r.qid == 7] == [20_000, 20_001, 20_002, 20_003, 20_004] and {r.qid for r in got} == {7, 8}
    with pytest.raises(ValueError):
        VectorIndex(Store(spark, store.root + "-none")).rebuild(odd.filter("vec_id <> 9005"))


def test_codes_bound_the_scores(spark):
    import numpy as np

    r = np.random.default_rng(3)
    book = ann.Codebook(r.normal(size=(5, 6)), r.normal(size=(3, 7, 2)))
    m = r.normal(size=(50, 6))
    cell, code, rest = book.encode(m)
    assert np.allclose(np.sqrt(((m - book.cells[cell] - book.decode(code)) ** 2).sum(axis=1)), rest)
    plain = [min(((x - book.cells[c] - np.concatenate([book.words[0][i], book.words[1][j], book.words[2][k]])) ** 2).sum() for i in range(7) for j in range(7) for k in range(7)) for x, c in zip(m, cell)]
    assert np.allclose(np.array(plain) ** 0.5, rest)


def test_best_of_blocks_are_those_of_all_scores(spark, store, monkeypatch):
    import random

    monkeypatch.setattr(lexical, "ITEM_BLOCK", 7)
    monkeypatch.setattr(lexical, "DOC_BLOCK", 16)
    monkeypatch.setattr(lexical, "AT_ONCE", 64)
    r = random.Random(9)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["缓存", "内存"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(i, text(r.randrange(30))) for i in range(150)] + [(200 + i, "wa wb wb 缓存") for i in range(90)] + [(400, None), (401, ""), (402, "zz"), (403, "wa wc"), (403, "wc wd"), (-5, "wa wb wb 缓存")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(i, text(r.randrange(1, 9))) for i in range(40)] + [(50, "wa wb 缓存"), (51, "nowhere"), (52, "")], "item_id long, text string")
    index, terms = LexicalIndex(store), lexical.query_terms(items)
    index.rebuild(docs.filter("doc_id % 2 = 0"))
    index.add(docs)
    rows = lambda df: sorted(map(tuple, df.select("item_id", "doc_id", "score", "rnk").collect()))
    assert rows(index.top_k(terms, 5)) == rows(lexical.top_k(index.bm25(terms), 5))
    plain = index.postings().join(terms, "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    assert rows(index.overlap_top_k(terms, 5)) == rows(lexical.top_k(plain, 5))
    assert [x.doc_id for x in index.top_k(terms, 5).filter("item_id = 50").orderBy("rnk").collect()][:1] in ([-5], [200], [403]) and index.store.read("documents").filter("doc_id = 403").first().dl == 4
    plan = index.top_k(terms, 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "doc_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning(item_id" in x and "doc_id," in x.split("hashpartitioning")[1])


def test_vectors_of_counts_are_those_of_texts(spark, sf, store):
    docs, index = spark.read.parquet(f"{sf}/documents.parquet"), LexicalIndex(store)
    index.rebuild(docs)
    want = {x.id: x.embedding for x in dense.packed(dense.hashed_vectors(docs, "doc_id")).collect()}
    got = {x.doc_id: x.embedding for x in dense.counted_vectors(index.forward()).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-12 for i in got for a, b in zip(got[i], want[i]))
