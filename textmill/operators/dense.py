"""Vectors: exact top-k and hashed text vectors; the approximate search is in ``ann``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions import text as tx
from textmill.operators.lexical import small, top_k

DIM = 256
#: Rows of a block of queries and of a block of vectors.
QUERY_BLOCK, VECTOR_BLOCK = 512, 2048


def blocks(vectors: DataFrame, id_col: str, rows: int) -> DataFrame:
    """(ids array<long>, m binary): vectors packed into row-major matrices of doubles, ``rows`` to a block at most, all of one length in a block. Rows without a vector are left out."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                ids, vecs = b.column(0).slice(at, rows).to_numpy(zero_copy_only=False), b.column(1).slice(at, rows)
                sizes = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
                whole = vecs.flatten().to_numpy(zero_copy_only=False)
                for n in np.unique(sizes).tolist():
                    m = whole[np.repeat(sizes == n, sizes)].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[sizes == n].tolist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], names=["ids", "m"])

    return vectors.filter("size(embedding) > 0").select(F.col(id_col).cast("long"), F.transform("embedding", lambda v: F.coalesce(v, F.lit(0.0)).cast("double")).alias("v")).mapInArrow(f, "ids array<long>, m binary")


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, by: str = "vec_id", ident: str = "vec_id", other: bool = True) -> DataFrame:
    """(qid, ``ident``, score, rnk): exact cosine of a stated query set against all vectors; with ``other``, a vector isn't its own hit.

    Both sides are packed into blocks, a product of matrices scores each two of
    them, and only what may be among a query's k best of a block goes on. The
    blocks of the queries are broadcast if their number allows.
    """
    q = blocks(queries.select(by, "embedding"), by, QUERY_BLOCK).select(F.col("ids").alias("qids"), F.col("m").alias("q"))
    pairs = blocks(vectors.select(ident, "embedding"), ident, VECTOR_BLOCK).crossJoin(small(q, 16)).filter("length(q) div size(qids) = length(m) div size(ids)")

    def unit(ids: list[int], raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        m = np.frombuffer(raw).reshape(len(ids), -1)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.array(ids, np.int64), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, m = unit(b.column(0)[i].as_py(), b.column(1)[i].as_py())
                qids, qm = unit(b.column(2)[i].as_py(), b.column(3)[i].as_py())
                s = qm @ m.T
                if other:
                    s[qids[:, None] == ids[None, :]] = -2.0
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(qids), -2.0)
                # scores are rounded before they are ranked, so what rounding may lift stays
                r, c = np.nonzero(s >= np.maximum(least - 2e-6, 1e-9)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(qids[r]), pa.array(ids[c]), pa.array(s[r, c])], names=["qid", ident, "score"])

    scored = pairs.select("ids", "m", "qids", "q").mapInArrow(f, f"qid long, {ident} long, score double")
    return top_k(scored.withColumn("score", F.round("score", 6)), k, "qid", ident)


def _labelled(vectors: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """(ids array<long>, labels array, m binary): as ``blocks``, with a label for each vector. Vectors that are null, empty or have null entries are of no dimension."""
    kind = vectors.schema[label_col].dataType

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                vecs = part.column(2)
                sizes = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
                whole = vecs.flatten().to_numpy(zero_copy_only=False)
                for n in np.unique(sizes).tolist():
                    own = pa.array(np.flatnonzero(sizes == n))
                    m = whole[np.repeat(sizes == n, sizes)].astype(np.float64)
                    ends = pa.array([0, len(own)], pa.int32())
                    yield pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(ends, part.column(i).take(own)) for i in (0, 1)), pa.array([m.tobytes()], pa.binary())], names=["ids", "labels", "m"])

    e = F.col("embedding")
    sound = F.when(e.isNotNull() & ~F.exists(e, lambda x: x.isNull()), F.transform(e, lambda x: x.cast("double"))).otherwise(F.array().cast("array<double>"))
    return vectors.select(F.col(id_col).cast("long"), F.col(label_col), sound.alias("v")).mapInArrow(f, f"ids array<long>, labels array<{kind.simpleString()}>, m binary")


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed from left to right: equal rows have equal sums wherever they stand, which a product of matrices doesn't promise."""
    return np.cumsum(a * b, axis=1)[:, -1]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``tx.cosine`` row by row, to the last bit."""
    out = np.zeros(len(a))
    for at in range(0, len(a) if a.shape[1] == b.shape[1] and a.shape[1] else 0, 1 << 15):
        x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
        norm = np.sqrt(_folded(x, x)) * np.sqrt(_folded(y, y))
        out[at : at + (1 << 15)] = np.divide(_folded(x, y), norm, out=np.zeros(len(x)), where=norm != 0)
    return out


def _label_scores(queries: DataFrame, vectors: DataFrame, own: bool, by: str, label: str) -> DataFrame:
    """(qid, label, vec_id, score): what may be the best of ``label_best``, a row for each query and label of two blocks.

    Products of matrices name the candidates of two blocks, a fold like
    ``tx.cosine`` scores them (with ``own``: one row for each score within the
    rounding of the best).
    """
    cols = [F.col(c).alias(f"q{c}") for c in ("ids", "labels", "m")]
    pairs = _labelled(vectors, by, label, VECTOR_BLOCK).crossJoin(small(_labelled(queries, by, label, QUERY_BLOCK).select(*cols), 64))
    kind = vectors.schema[label].dataType.simpleString()

    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm != 0)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels, qids, qlabels = (b.column(c)[i].values for c in (0, 1, 3, 4))
                n, nq = len(ids), len(qids)
                m, qm = np.frombuffer(b.column(2)[i].as_py()).reshape(n, -1), np.frombuffer(b.column(5)[i].as_py()).reshape(nq, -1)
                vid, qid = ids.to_numpy(), qids.to_numpy()
                codes = pc.dictionary_encode(pa.concat_arrays([labels, qlabels]), null_encoding="encode").indices.to_numpy()
                order = np.lexsort((vid, codes[:n]))
                code, vid, m = codes[:n][order], vid[order], m[order]
                with np.errstate(all="ignore"):
                    s = unit(qm) @ unit(m).T if m.shape[1] == qm.shape[1] else np.zeros((nq, n))
                    s[np.isnan(s)] = np.inf
                    s[qid[:, None] == vid[None, :]] = -np.inf
                    if own:
                        s[(codes[n:, None] != code[None, :]) | np.array(qlabels.is_null())[:, None]] = -np.inf
                        least = s.max(axis=1, keepdims=True) - 2e-6
                    else:
                        starts = np.flatnonzero(np.diff(code, prepend=-1))
                        least = np.repeat(np.maximum.reduceat(s, starts, axis=1), np.diff(starts, append=n), axis=1)
                    r, c = np.nonzero((s >= least) & (s > -np.inf))
                    if not own:
                        one = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(code[c], prepend=-1) != 0))
                        r, c = r[one], c[one]
                    score = _cosines(qm[r], m[c])
                if own:
                    keep = np.lexsort((vid[c], score, r))
                    r, c, score = r[keep], c[keep], score[keep]
                    one = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(score, prepend=-9.0) != 0))
                    r, c, score = r[one], c[one], score[one]
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), labels.take(pa.array(order[c])), pa.array(vid[c]), pa.array(score)], names=["qid", "label", "vec_id", "score"])

    return pairs.select("ids", "labels", "m", "qids", "qlabels", "qm").mapInArrow(f, f"qid long, label {kind}, vec_id long, score double")


def label_max(queries: DataFrame, vectors: DataFrame, by: str = "vec_id", label: str = "label") -> DataFrame:
    """(qid, label, score): the scores of ``label_best`` alone, for whole tables of queries: the rows of the blocks are added up by hash, without a sort."""
    return _label_scores(queries, vectors, False, by, label).groupBy("qid", "label").agg(F.max("score").alias("score"))


def label_best(queries: DataFrame, vectors: DataFrame, own: bool = False, by: str = "vec_id", label: str = "label") -> DataFrame:
    """(qid, label, vec_id, score): a query's best cosine over the vectors of each label, itself left out, and the least vec_id that has it.

    With ``own``, over the vectors of the query's label only, scores rounded to
    six places before the least vec_id is taken; null labels match nothing.
    Vectors of another length, or without a sound one, have cosine 0.
    """
    scored = _label_scores(queries, vectors, own, by, label)
    if own:
        scored = scored.withColumn("score", F.round("score", 6))
    best = scored.groupBy("qid", "label").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("at"))).alias("b"))
    return best.select("qid", "label", (-F.col("b.at")).alias("vec_id"), F.col("b.score").alias("score"))


def hashed_vectors(docs: DataFrame, id_col: str, dim: int = DIM) -> DataFrame:
    """(id, bucket, w): sparse unit vectors; token weights 1 + ln tf with a sign by hash."""
    tf = docs.select(F.col(id_col).alias("id"), F.explode(tx.tokens(F.col("text"))).alias("t")).groupBy("id", "t").agg(F.count(F.lit(1)).alias("n"))
    b = tf.groupBy("id", tx.bucket(F.col("t"), dim).alias("bucket")).agg(F.sum(tx.bucket_sign(F.col("t")) * (1 + F.log(F.col("n")))).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))
    return b.filter("v <> 0").select("id", "bucket", (F.col("v") / norm).alias("w"))


def counted_vectors(forward: DataFrame, dim: int = DIM) -> DataFrame:
    """(doc_id, embedding): the vectors of ``hashed_vectors`` as dense arrays, from the term counts of an index, a document at a time and without a shuffle."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, VECTOR_BLOCK):
                part = b.slice(at, VECTOR_BLOCK)
                n = pc.list_value_length(part.column(1)).to_numpy()
                flat = part.column(1).flatten().dictionary_encode()
                digest = [hashlib.md5(t.encode()).hexdigest() for t in flat.dictionary.to_pylist()]
                bucket = np.array([int(h[:8], 16) % dim for h in digest], np.int64)
                sign = np.array([1.0 if int(h[9], 16) % 2 else -1.0 for h in digest])
                code = flat.indices.to_numpy()
                w = sign[code] * (1 + np.log(part.column(2).flatten().to_numpy()))
                m = np.bincount(np.repeat(np.arange(len(n)), n) * dim + bucket[code], weights=w, minlength=len(n) * dim).reshape(len(n), dim)
                norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
                m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                ends = pa.array(np.arange(len(n) + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(m.ravel()))], names=["doc_id", "embedding"])

    return forward.filter("size(terms) > 0").select("doc_id", "terms", "tfs").mapInArrow(f, "doc_id long, embedding array<double>")


def packed(sparse: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, embedding) as dense arrays."""
    m = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
    return m.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0))).alias("embedding"))
