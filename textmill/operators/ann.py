"""Approximate nearest neighbours by a trained index: coarse cells and residual codes, stored as tables.

Vectors are unit vectors, so the score is their cosine. Cells are centroids that
distributed Lloyd passes move over a bounded sample; their number grows with
the root of the rows. What a vector differs from its centroid is coded in
``PARTS`` groups of coordinates by the nearest of up to ``CODES`` code words
each, trained alike. The index keeps, for every row, its cell, its code, the
length of what the code leaves over, and the vector.

A search scores codes by table lookups and compares whole vectors only where
the code can't decide. The part of the left-over vector that lies along the
query has about its length over the root of the dimension as its spread, so
the score is at most ``SPREAD`` times that over the code's. The best codes of a
query's nearest cells, which hold ``FIRST`` times k rows at least, are compared
first and give a bound for its k-th score. Of all cells those are probed whose
best possible score reaches it: how many, each query decides. The best codes of
these are compared and raise the bound; then all whose code may reach it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.lexical import top_k
from textmill.storage import Manifest, Store, checkpointed

#: Rows that training takes at most, chosen by hashes of their ids; Lloyd passes.
SAMPLE, PASSES = 100_000, 8
PARTS, CODES = 16, 256
FIRST, SPREAD = 2, 2.5
#: Rows of a block of codes, and of a block of queries.
BLOCK, QUERIES = 4096, 128


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of unit length. Rows without a whole vector of finite entries, or of length 0, are left out."""
    v = F.col("v")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.filter(v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))).filter("norm > 0")
    return rows.select("id", F.transform("v", lambda e: e / F.col("norm")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all vectors of ``size`` doubles that ``f`` makes of a matrix of them; a partial sum per task is shuffled by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f(_matrix(b.column(0))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["p"])

    got = rows.select("v").mapInArrow(partial, "p array<double>").select(F.posexplode("p").alias("i", "x")).filter("x <> 0").groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(size)
    for r in got.collect():  # ``size`` rows at most: cells or code words times dimensions
        out[r.i] = r.x
    return out


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return (2 * m @ centres.T - (centres * centres).sum(axis=1)).argmax(axis=1)


def _lloyd(rows: DataFrame, centres: np.ndarray, passes: int) -> np.ndarray:
    """Centres after passes over a table of vectors; ``centres`` has one or more independent groups: (groups, centres, dimensions of a group)."""
    g, k, d = centres.shape
    for _ in range(passes):
        now = centres

        def one(m: np.ndarray, now: np.ndarray = now) -> np.ndarray:
            out = np.zeros((g, k, d + 1))
            for i in range(g):
                part = m[:, i * d : (i + 1) * d]
                at = _nearest(part, now[i])
                np.add.at(out[i, :, :d], at, part)
                out[i, :, d] = np.bincount(at, minlength=k)
            return out

        got = _sums(rows, one, g * k * (d + 1)).reshape(g, k, d + 1)
        some = got[..., d:] > 0
        centres = np.where(some, got[..., :d] / np.maximum(got[..., d:], 1), centres)
    return centres


def _groups(d: int, parts: int) -> int:
    """The largest number of equal groups of coordinates up to ``parts``."""
    return max(g for g in range(1, min(parts, d) + 1) if d % g == 0)


class Codebook:
    """Centroids of cells and code words of what is left over."""

    def __init__(self, cells: np.ndarray, words: np.ndarray) -> None:
        self.cells, self.words = cells, words  # (cells, d), (groups, code words, d / groups)

    def encode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code and left-over length of each row."""
        cell = _nearest(m, self.cells)
        rest = m - self.cells[cell]
        g, _, d = self.words.shape
        code = np.stack([_nearest(rest[:, i * d : (i + 1) * d], self.words[i]) for i in range(g)], axis=1).astype(np.uint8)
        return cell, code, np.sqrt(((rest - self.decode(code)) ** 2).sum(axis=1))

    def decode(self, code: np.ndarray) -> np.ndarray:
        """Left-over vectors of codes."""
        return np.concatenate([self.words[i][code[:, i]] for i in range(len(self.words))], axis=1)


def train(rows: DataFrame, n: int, sample: int = SAMPLE, parts: int = PARTS, passes: int = PASSES) -> Codebook:
    """A codebook of ``n`` unit vectors, learnt from at most ``sample`` of them."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    some = rows if n <= sample else rows.filter(place < int((1 << 40) * sample / n))
    cells = max(1, round(n**0.5))
    first = some.orderBy(place, "id").limit(min(cells, sample)).select("v").collect()  # as many rows as cells
    centres = np.array([r.v for r in first])[None]
    cells = _lloyd(some, centres, passes)[0]
    d = cells.shape[1]
    g, k = _groups(d, parts), max(1, min(CODES, min(n, sample) // 8))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array((m - cells[_nearest(m, cells)]).tolist(), pa.list_(pa.float64()))], names=["id", "v"])

    left = some.select("id", "v").mapInArrow(rest, "id long, v array<double>")
    first = left.orderBy(place, "id").limit(k).select("v").collect()  # CODES rows at most
    start = np.array([r.v for r in first]).reshape(len(first), g, d // g).transpose(1, 0, 2)
    return Codebook(cells, _lloyd(left, start, passes))


CODED = "id long, cell int, code binary, rest double, v array<double>"


def _coded(rows: DataFrame, book: Codebook) -> DataFrame:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, code, rest = book.encode(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(rest), b.column(1)], names=["id", "cell", "code", "rest", "v"])

    return rows.select("id", "v").mapInArrow(f, CODED)


class VectorIndex:
    """A stored index: tables ``cells`` (cell, v), ``words`` (part, word, v) and ``vectors`` (id, cell, code, rest, v)."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def rebuild(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, parts: int = PARTS) -> Manifest:
        """Trains on the vectors and replaces all tables in one commit. Rows of an id that repeats stay as they are; vectors have the length that most have."""
        spark, base = vectors.sparkSession, self.store.manifest()
        rows = checkpointed(unit_vectors(vectors, id_col, vector_col))
        sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
        if not sizes:
            raise ValueError("an index needs vectors")
        rows = rows.filter(F.size("v") == sizes[0].d)
        book = train(rows, sizes[0].n, sample, parts)
        cells = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(book.cells)], "cell int, v array<double>")
        words = spark.createDataFrame([(i, j, v.tolist()) for i, part in enumerate(book.words) for j, v in enumerate(part)], "part int, word int, v array<double>")
        return self._publish(base, _coded(rows, book), {"cells": cells, "words": words}, {"d": sizes[0].d})

    def _publish(self, base: Manifest, coded: DataFrame, replaced: dict[str, DataFrame], notes: dict) -> Manifest:
        # rows of a cell lie together; a large one is spread over several files
        dealt = coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("cell")
        if replaced:
            return self.store.commit(base, {**replaced, "vectors": dealt}, notes=notes)
        return self.store.commit(base, added={"vectors": dealt})

    def add(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Manifest:
        """Adds the vectors whose id the index hasn't, coded by its codebook; adding twice changes nothing. Of several rows of an id one is added."""
        base = self.store.manifest()
        rows = unit_vectors(vectors, id_col, vector_col).filter(F.size("v") == base.notes["d"])
        fresh = checkpointed(rows.join(self.store.read("vectors", base.version).select("id"), "id", "left_anti").groupBy("id").agg(F.min("v").alias("v")))
        return base if fresh.isEmpty() else self._publish(base, _coded(fresh, self.codebook(base.version)), {}, base.notes)

    def codebook(self, version: int | None = None) -> Codebook:
        """The stored codebook; its size is bounded by the root of the rows and the number of code words."""
        cells = self.store.read("cells", version).orderBy("cell").collect()
        words = self.store.read("words", version).orderBy("part", "word").collect()
        parts = max(r.part for r in words) + 1
        return Codebook(np.array([r.v for r in cells]), np.array([r.v for r in words]).reshape(parts, len(words) // parts, -1))

    def search(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", other: bool = True, spread: float = SPREAD) -> DataFrame:
        """(qid, id, score, rnk, probed, compared): the k best of each query by cosine, positive ones only, ties by id.

        ``probed`` counts the codes that a query's cells hold, ``compared`` the
        whole vectors that it was compared with. With ``other``, a vector isn't
        its own hit. Queries of other lengths or without a vector have no hits.
        """
        version = self.store.version()
        book, rows = self.codebook(version), self.store.read("vectors", version)
        # how far a cell's vectors lie from its centroid: a bound for their scores
        shape = rows.select("cell", "v").mapInArrow(_distances(book.cells), "cell int, far double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"))
        held, radius = np.zeros(len(book.cells), np.int64), np.zeros(len(book.cells))
        for r in shape.collect():  # a row per cell
            held[r.cell], radius[r.cell] = r.n, r.far
        d = book.cells.shape[1]
        q = unit_vectors(queries, id_col, vector_col).filter(F.size("v") == d).select(F.col("id").alias("qid"), F.col("v").alias("q"))
        q = checkpointed(q)
        parts = F.lit([int(-(-n // BLOCK)) or 1 for n in held])[F.col("cell")]
        blocks = rows.groupBy("cell", F.pmod(F.xxhash64("id"), parts).alias("part")).agg(F.collect_list(F.struct("id", "code", "rest")).alias("rows"))
        first = q.mapInArrow(_first_cells(book.cells, held, FIRST * k + 1), "qid long, q array<double>, cell int")
        deals = max(1, -(-q.count() // (8 * QUERIES)))
        score = lambda cells, top=None: _scored(cells, blocks, book, d, spread, other, deals, k, top)
        exact = lambda chosen: _compared(chosen, rows, q)
        near = checkpointed(_best(score(first, FIRST * k), FIRST * k))
        best = exact(near)
        rest = q.join(_kth(best, k), "qid", "left").mapInArrow(_probed_cells(book.cells, held, radius), "qid long, q array<double>, cell int, least double")
        found = checkpointed(score(rest))
        likely = checkpointed(_best(found, FIRST * k))
        bound = _kth(exact(likely), k)
        chosen = found.join(bound, "qid", "left").filter("least is null or up >= least")
        sizes = self.store.spark.createDataFrame([(i, int(n)) for i, n in enumerate(held)], "cell int, n long")
        probed = rest.select("qid", "cell").join(sizes, "cell").groupBy("qid").agg(F.sum("n").alias("probed"))
        looked = chosen.select("qid", "id").union(near.select("qid", "id")).union(likely.select("qid", "id")).distinct()
        counts = looked.groupBy("qid").agg(F.count(F.lit(1)).alias("compared")).join(probed, "qid")
        return top_k(exact(chosen), k, "qid", "id").join(counts, "qid").select("qid", "id", "score", "rnk", "probed", "compared")


def _distances(cells: np.ndarray) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.sqrt(((_matrix(b.column(1)) - cells[cell]) ** 2).sum(axis=1)))], names=["cell", "far"])

    return f


def _order(m: np.ndarray, cells: np.ndarray, held: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the centroids, cells by falling score for each query, and how many of them are needed to hold ``rows`` rows."""
    s = m @ cells.T
    order = np.argsort(-s, axis=1)
    return s, order, (np.cumsum(held[order], axis=1) < rows).sum(axis=1) + 1


def _best(found: DataFrame, n: int) -> DataFrame:
    """The n best codes of each query."""
    w = Window.partitionBy("qid").orderBy(F.desc("up"), "id")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select("qid", "id", "cell")


def _compared(chosen: DataFrame, rows: DataFrame, q: DataFrame) -> DataFrame:
    """(qid, id, score): cosines of chosen queries and vectors."""
    pairs = rows.select("id", "cell", "v").join(chosen.select("qid", "id", "cell"), ["id", "cell"]).join(q, "qid")
    return pairs.select("qid", "id", F.round(F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e), 6).alias("score"))


def _first_cells(cells: np.ndarray, held: np.ndarray, rows: int) -> Callable:
    """Queries once for each of their nearest cells."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, order, need = _order(_matrix(b.column(1)), cells, held, rows)
                at = np.repeat(np.arange(b.num_rows), np.minimum(need, len(cells)))
                cell = np.concatenate([o[:n] for o, n in zip(order, need)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(cell.astype(np.int32))], names=["qid", "q", "cell"])

    return f


def _probed_cells(cells: np.ndarray, held: np.ndarray, radius: np.ndarray) -> Callable:
    """Queries once for each cell whose best possible score reaches their bound."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                least = np.nan_to_num(b.column(2).to_numpy(zero_copy_only=False).astype(float), nan=-2.0) - 1e-6
                at, cell = np.nonzero((_matrix(b.column(1)) @ cells.T + radius >= least[:, None]) & (held > 0))
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell.astype(np.int32)), pa.array(least).take(at)], names=["qid", "q", "cell", "least"])

    return f


def _kth(exact: DataFrame, k: int) -> DataFrame:
    """(qid, least): the k-th score of each query that has so many."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"))
    return exact.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("qid", F.col("score").alias("least"))


def _scored(at_cells: DataFrame, blocks: DataFrame, book: Codebook, d: int, spread: float, other: bool, deals: int, k: int, top: int | None) -> DataFrame:
    """(qid, id, cell, up): upper bounds of scores from codes; the ``top`` best of each block, or all that reach their query's bound. Of rows with one code and left-over length, which are copies, the k least ids count."""
    if "least" not in at_cells.columns:
        at_cells = at_cells.withColumn("least", F.lit(-2.0))
    dealt = at_cells.withColumn("deal", F.pmod(F.xxhash64("qid"), F.lit(deals)))
    groups = dealt.groupBy("cell", "deal").agg(F.collect_list(F.struct("qid", "q", "least")).alias("queries"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, rows, queries in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                ids = rows.values.field("id").to_numpy()
                code = np.frombuffer(b"".join(rows.values.field("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                margin = rows.values.field("rest").to_numpy() * spread / np.sqrt(d)
                qids = queries.values.field("qid").to_numpy()
                qm, least = _matrix(queries.values.field("q")), queries.values.field("least").to_numpy()
                for i in range(0, len(qids), QUERIES):
                    part = slice(i, i + QUERIES)
                    g, _, size = book.words.shape
                    table = np.einsum("qgd,gwd->qgw", qm[part].reshape(-1, g, size), book.words)
                    s = (qm[part] @ book.cells[cell])[:, None] + sum(table[:, j, code[:, j]] for j in range(g))
                    if other:
                        s[qids[part][:, None] == ids[None, :]] = -4.0
                    up = s + margin
                    bound = least[part]
                    if top and len(ids) > top:
                        bound = np.partition(up, -top, axis=1)[:, -top]
                    r, c = np.nonzero((up >= bound[:, None]) & (s > -3))
                    order = np.lexsort((ids[c], margin[c], s[r, c], r))
                    r, c = r[order], c[order]
                    new = np.ones(len(r), bool)
                    new[1:] = (r[1:] != r[:-1]) | (s[r, c][1:] != s[r, c][:-1]) | (margin[c][1:] != margin[c][:-1])
                    place = np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
                    r, c = r[place < k], c[place < k]
                    yield pa.RecordBatch.from_arrays([pa.array(qids[part][r]), pa.array(ids[c]), pa.array(np.full(len(r), cell, np.int32)), pa.array(up[r, c])], names=["qid", "id", "cell", "up"])

    return groups.join(blocks, "cell").select("cell", "rows", "queries").mapInArrow(f, "qid long, id long, cell int, up double")
