"""Inverted index as tables, BM25, term weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.config import DEFAULT
from textmill.functions import text as tx

#: Rows and bytes of a query side that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
#: Items of a block of queries and documents of a block; terms of items and documents that are multiplied at once, about.
ITEM_BLOCK, DOC_BLOCK, AT_ONCE = 512, 1024, 1 << 21


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and lists by their lengths, the rest as eight each."""
    size = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(df[name]), F.lit(0))
        elif kind.startswith("array"):
            size = size + 16 * F.greatest(F.coalesce(F.size(df[name]), F.lit(0)), F.lit(0))
    return size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if it has at most that many rows and bytes, as counted."""
    got = df.limit(rows + 1).select(_bytes(df).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if got.n <= rows and got.b <= most else df


def hinted(df: DataFrame, few: bool) -> DataFrame:
    """The table with a broadcast hint if a bound on its rows has been checked."""
    return F.broadcast(df) if few else df


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl): term counts and the document's length. A document's tokens stand in one task, so the counts are complete before the shuffle."""
    t = docs.select(F.col(id_col).alias("doc_id"), tx.tokens(F.col(text_col)).alias("t"))
    counted = t.select("doc_id", F.size("t").alias("dl"), F.explode(F.array_sort("t")).alias("term"))
    return counted.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def document_frequency(post: DataFrame) -> DataFrame:
    """(term, df)."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: documents and their mean length in tokens."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tx.tokens(F.col(text_col)))).alias("avg_dl"))


def query_terms(items: DataFrame, n: int | None = None) -> DataFrame:
    """(item_id, term, qtf) of all tokens of the texts, or of the first ``n``."""
    t = tx.tokens(F.col("text"))
    t = items.select("item_id", F.explode(t if n is None else F.slice(t, 1, n)).alias("term"))
    return t.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, score) of every document with a query term, without an index. The postings of other terms are dropped before they are counted per document."""
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # bounds what is derived from the terms too
    wanted = terms.select("term").distinct()
    t = docs.select("doc_id", tx.tokens(F.col("text")).alias("t"))
    rows = t.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(hinted(wanted, few), "term", "left_semi")
    post = rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    df = document_frequency(post)
    k1, b = DEFAULT.bm25_k1, DEFAULT.bm25_b
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.join(df, "term").crossJoin(F.broadcast(corpus_stats(docs))).select("item_id", "term", "avg_dl", (idf * F.col("qtf")).alias("w"))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return post.join(hinted(weighed, few), "term").groupBy("item_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "item_id", ident: str = "doc_id") -> DataFrame:
    """The k best of each group with their rank, ties by id; positive scores only."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), ident)
    return scores.filter("score > 0").withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, digest, terms array<string>, tfs array<int>) of (doc_id, t, digest): the tokens of each row counted where they are, without a shuffle."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, DOC_BLOCK):
                part = b.slice(at, DOC_BLOCK)
                t = part.column(1)
                n = pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = t.flatten().dictionary_encode()
                words = max(1, len(flat.dictionary))
                key, count = np.unique(np.repeat(np.arange(len(n)), n) * words + flat.indices.to_numpy().astype(np.int64), return_counts=True)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(key // words, minlength=len(n)))), pa.int32())
                terms = pa.ListArray.from_arrays(ends, flat.dictionary.take(pa.array(key % words)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), part.column(2), terms, pa.ListArray.from_arrays(ends, pa.array(count, pa.int32()))], names=["doc_id", "dl", "digest", "terms", "tfs"])

    return docs.select("doc_id", "t", "digest").mapInArrow(f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, dl long, digest string, terms array<string>, tfs array<int>")


def exploded(forward: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl): a row per document and term."""
    rows = forward.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return rows.select("doc_id", F.col("x.terms").alias("term"), F.col("x.tfs").cast("long").alias("tf"), F.col("dl").cast("int").alias("dl"))


def _doc_blocks(forward: DataFrame) -> DataFrame:
    """Documents packed into blocks in the order of their ids: ids, lengths, numbers of terms, term counts, and the terms as offsets and characters."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, DOC_BLOCK):
                part = b.slice(at, DOC_BLOCK)
                part = part.take(pc.array_sort_indices(part.column(0)))
                terms, tfs = part.column(2).flatten().cast(pa.large_string()), part.column(3).flatten()
                terms = pa.concat_arrays([terms])
                ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int64)
                chars = (terms.buffers()[2].to_pybytes() if len(terms) else b"")[int(ends[0]) : int(ends[-1])]
                out = [part.column(0).to_numpy().astype(np.int64), part.column(1).to_numpy().astype(np.int64), pc.list_value_length(part.column(2)).to_numpy().astype(np.int64), tfs.to_numpy().astype(np.int64), ends - ends[0]]
                yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in out), pa.array([chars], pa.binary())], names=["ids", "dl", "n", "tf", "ends", "chars"])

    cols = ("ids", "dl", "n", "tf", "ends", "chars")
    return forward.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "dl", "terms", "tfs").mapInArrow(f, ", ".join(f"{c} binary" for c in cols))


def block_top_k(terms: DataFrame, forward: DataFrame, k: int, avg_dl: float | None) -> DataFrame:
    """(item_id, doc_id, score, rnk): the k best documents of every item; ``terms`` has item_id, term and w, each item and term once.

    A score is the sum over common terms of w times the BM25 part of the
    document's count, or of w alone where ``avg_dl`` is None, rounded to six
    places. Documents and items are packed into blocks, each two of them are
    scored in a task by adding up their common terms in the order of the terms,
    so equal documents have equal scores, and only what may be among an item's k
    best goes on. The items' blocks are broadcast if their bytes allow.
    """
    n = -(-terms.select("item_id").distinct().count() // ITEM_BLOCK) or 1
    q = terms.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("term", "item_id", F.col("w").cast("double").alias("w")))).alias("q")).select("q")
    pairs = _doc_blocks(forward).crossJoin(small(q, most=BROADCAST_BYTES // 2))
    k1, slope = DEFAULT.bm25_k1, DEFAULT.bm25_b

    def scores(d: dict, q: tuple, items: int) -> np.ndarray:
        """Items by documents."""
        term, item, w = q
        vocabulary, starts = np.unique(np.array(term.dictionary_encode().indices), return_index=True)
        code = pc.index_in(d["terms"], value_set=term.take(pa.array(starts)))
        at = np.flatnonzero(np.array(code.is_valid()))
        code = code.take(pa.array(at)).to_numpy().astype(np.int64)
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[order]
        doc, tf = d["doc"][at], d["tf"][at].astype(np.float64)
        part = np.ones(len(at)) if avg_dl is None else tf * (k1 + 1) / (tf + k1 * (1 - slope + slope * d["dl"][doc] / avg_dl))
        ends = np.append(starts, len(item))
        per = ends[code + 1] - ends[code]
        out, docs = np.zeros(items * len(d["ids"])), len(d["ids"])
        cuts = np.searchsorted(np.cumsum(per), np.arange(AT_ONCE, per.sum() + AT_ONCE, AT_ONCE))
        low = 0
        for high in np.minimum(cuts + 1, len(per)).tolist():
            c = per[low:high]
            pick = np.repeat(ends[code[low:high]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            place = item[pick] * docs + np.repeat(doc[low:high], c)
            out += np.bincount(place, weights=w[pick] * np.repeat(part[low:high], c), minlength=len(out)) if len(place) else 0.0
            low = high
        return out.reshape(items, docs)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars, last, d = {}, None, {}
        for b in batches:
            for i in range(b.num_rows):
                raw = [b.column(c)[i].as_buffer() for c in range(6)]
                if last is None or not raw[0].equals(last):
                    ids, dl, size, tf = (np.frombuffer(x, np.int64) for x in raw[:4])
                    chars = pa.LargeStringArray.from_buffers(len(tf), raw[4], raw[5])
                    last, d = raw[0], {"ids": ids, "dl": dl, "tf": tf, "doc": np.repeat(np.arange(len(ids)), size), "terms": chars}
                x = b.column(6)[i].values
                term, ids = x.field(0).cast(pa.large_string()), x.field(1).to_numpy()
                names, item = np.unique(ids, return_inverse=True)
                s = scores(d, (term, item, x.field(2).to_numpy()), len(names))
                key = names.tobytes()
                bar = bars.get(key, np.zeros(len(names)))
                if s.shape[1] >= k:
                    bar = bars[key] = np.maximum(bar, np.partition(s, -k, axis=1)[:, -k])
                # scores are rounded before they are ranked, so what rounding may lift stays
                r, c = np.nonzero((s >= (bar - 2e-6)[:, None]) & (s > 0))
                v = s[r, c]
                # of equal scores, the k least ids
                order = np.lexsort((c, v, r))
                r, c, v = r[order], c[order], v[order]
                fresh = np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1]))[: len(r)]
                place = np.arange(len(r)) - np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))
                r, c, v = (x[place < k] for x in (r, c, v))
                yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(d["ids"][c]), pa.array(v)], names=["item_id", "doc_id", "score"])

    scored = pairs.mapInArrow(f, "item_id long, doc_id long, score double")
    return top_k(scored.withColumn("score", F.round("score", 6)), k)


def idf_weight(df: Column, n: Column) -> Column:
    """Weight of a term for coverage: 1.5 where it never occurs, positive always."""
    ratio = (n - df + 0.5) / (df + 0.5)
    return F.when(n <= 0, 1.0).when(F.coalesce(df, F.lit(0)) <= 0, 1.5).when(ratio <= 0, 1e-6).otherwise(F.log(1 + ratio) + 0.1)


def delete_keys(word: Column) -> Column:
    """The word and what is left when one letter goes: words within one edit share one of these."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), cut))


def neighbours(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, neighbour) within one edit, both of two letters and more, by equal deletion keys and verification."""
    a = unknown.filter("length(term) >= 2").select("term", F.explode(delete_keys(F.col("term"))).alias("k"))
    b = vocabulary.filter("length(term) >= 2").select(F.col("term").alias("neighbour"), F.explode(delete_keys(F.col("term"))).alias("k"))
    return a.join(b, "k").select("term", "neighbour").distinct().filter(F.levenshtein("term", "neighbour", 1) >= 0)
