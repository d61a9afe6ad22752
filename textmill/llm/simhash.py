"""SimHash near-dedup by deletion-variant signatures.

A signature is cut into 32-bit segments. Two signatures within a distance d
have a segment in which they differ by at most one bit as soon as there are
more than d/2 segments, so they share one of that segment's 32 one-wildcard
variants (the segment with one bit blanked). Variants are equality-joined by a
shuffle, and what shares one is verified on whole signatures.

Families of near copies share most variants. Therefore the members of a shared
variant aren't paired with each other: they are reduced to a minimum spanning
forest under the Hamming distance, at most n-1 links for n members, which has
the same connected components as all pairs. A variant with more members than
``MAX_BUCKET`` is split again, without loss, by the one-wildcard variants of
16-bit and then 8-bit pieces of the other segments; for 64 bits that leaves at
most 2**11 different signatures that share a key. Longer signatures can share
more. Their dense keys, once of at most ``RUNS`` times that size or after the
8-bit level, are dealt into runs, and each two runs are reduced together, so
every pair of members meets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.components import connected_components
from textmill.llm.shared import by_arrow, joined, rows_out, written
from textmill.llm.shingle_hash import WordSignatures, hashes, shingles, simhash, words

MAX_BUCKET = 2048
RUNS = 64
#: Sets that are compared with each other in one go.
PART = 1024
#: A prefix has one more of so many hashes than would have to share one, and has to share one of so many.
SLACK = 20
#: Texts up to which their keys are broadcast to pick them; beyond, the join shuffles.
PICKED = 1_000_000
SIGNED = np.int64


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, sig array<long> of one word): SimHash of k-word shingles. Null and blank texts: 0."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = [[int(np.uint64(simhash(hashes(shingles(words(t), k)))).astype(SIGNED))] for t in b.column(1).to_pylist()]
            yield rows_out({"doc_id": (pa.int64(), b.column(0).to_pylist()), "sig": (pa.list_(pa.int64()), sigs)})

    return by_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), f, "doc_id long, sig array<long>")


def raw_key(text: Column) -> Column:
    """MD5 of a text; that of the empty one for null."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def least_common(n: int, similarity: float) -> int:
    """What a set of n has in common at least with any set that it reaches the similarity with."""
    return math.ceil(n * similarity - 1e-9)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrays of hashes as a column of lists of longs."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).astype(SIGNED)))


def _prefixes(docs: DataFrame, id_col: str, text_col: str, k: int, similarity: float) -> DataFrame:
    """(doc_id, raw key of the text, text_key of the sequence of words, size, prefix): the number of the text's distinct k-word shingles, and as many of their least hashes as have to hold more than a ``SLACK``-th of what it shares with a near copy."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, prefixes, keys = [], [], []
            for t in b.column(2).to_pylist():
                ws = words(t)
                keys.append(hashlib.md5(b" ".join(ws)).digest())
                h = np.unique(hashes(shingles(ws, k)))
                sizes.append(len(h))
                prefixes.append(h[: len(h) - least_common(len(h), similarity) + 1 + len(h) // SLACK])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), _lists(prefixes)], names=["doc_id", "raw", "text_key", "size", "prefix"])

    text = docs[text_col].cast("string")
    return by_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), raw_key(text).alias("raw"), text.alias("text")), f, "doc_id long, raw binary, text_key binary, size int, prefix array<long>")


def _shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, size, sig of four words, hashes ascending) of (id, text): word-set SimHash, and the text's k-word shingles."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = WordSignatures()
        for b in batches:
            ws = [words(t) for t in b.column(1).to_pylist()]
            sets = [np.unique(hashes(shingles(w, k))) for w in ws]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int32()), _lists([sign(w) for w in ws]), _lists(sets)], names=["id", "size", "sig", "hashes"])

    return by_arrow(texts.select("id", "text"), f, "id long, size int, sig array<long>, hashes array<long>")


def _with_variants(rows: DataFrame, pieces: int, width: int) -> DataFrame:
    """Each row once per one-wildcard variant of its signature's pieces of ``width`` bits: piece, and a number that no other variant has."""
    per, mask = 64 // width, (1 << width) - 1
    at = rows.withColumn("at", F.explode(F.expr(f"sequence(0, {pieces * width - 1})"))).withColumn("piece", F.expr(f"at div {width}").cast("int"))
    cut = F.expr(f"shiftrightunsigned(sig[cast(piece div {per} as int)], {width} * (piece % {per})) & {mask}L & ~shiftleft(1L, at % {width})")
    return at.withColumn("variant", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(cut)).drop("at")


def _shared_keys(rows: DataFrame) -> DataFrame:
    """Rows whose key occurs more than once, with that number."""
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")


def _in_runs(rows: DataFrame, most: int) -> DataFrame:
    """Rows of n members a key, with runs lo and hi: members are dealt into runs by hash, and each row comes once per run that its own is paired with."""
    dealt = rows.withColumn("runs", F.when(F.col("n") <= most, 1).otherwise(F.ceil(F.col("n") / max(1, most // 2))))
    dealt = dealt.withColumn("own", F.expr("pmod(xxhash64(id), runs)")).withColumn("other", F.explode(F.expr("sequence(0L, cast(runs as bigint) - 1)")))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def _forest(ids: np.ndarray, sigs: np.ndarray, distance: int) -> list[tuple[int, int, int]]:
    """Minimum spanning forest of the graph of pairs within the distance (Prim)."""
    n = len(ids)
    out, best, root = [], np.full(n, 1 << 20), np.zeros(n, np.int64)
    todo = np.ones(n, bool)
    at = 0
    for _ in range(n):
        todo[at] = False
        d = np.bitwise_count(sigs ^ sigs[at]).sum(axis=1, dtype=np.int64)
        closer = todo & (d < best)
        best[closer], root[closer] = d[closer], at
        left = np.flatnonzero(todo)
        if not len(left):
            break
        at = left[best[left].argmin()]
        if best[at] <= distance:
            out.append((int(ids[at]), int(ids[root[at]]), int(best[at])))
    return out


def bucket_links(nodes: DataFrame, segments: int, distance: int) -> DataFrame:
    """(a, b): links of a spanning forest of the nodes within the distance. ``nodes`` has id and sig; ids are unique."""
    rows = _with_variants(nodes, segments, 32)
    level = written(_shared_keys(rows.select("id", F.col("variant").alias("key"))), "variants")
    level = level.withColumn("seg", F.shiftrightunsigned("key", 37).cast("int"))
    lists, most = [], MAX_BUCKET if segments <= 2 else MAX_BUCKET * RUNS
    for width in (16, 8, 0):
        small = level if not width else level.filter(F.col("n") <= most)
        lists.append(_in_runs(small, MAX_BUCKET).groupBy("key", "lo", "hi").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids"))
        if not width or level.filter(F.col("n") > most).isEmpty():
            break
        big = level.filter(F.col("n") > most).join(nodes, "id")
        rows = _with_variants(big, segments * 32 // width, width)
        key = F.xxhash64("key", "variant").alias("key")
        if width == 16:
            next_rows = rows.filter("piece div 2 <> seg").select("id", "seg", F.col("piece").alias("half"), key)
        else:
            next_rows = rows.filter("piece div 4 <> seg and piece div 2 <> half").select("id", "seg", "half", key)
        level = written(_shared_keys(next_rows), "variants")
    ids = lists[0]
    for x in lists[1:]:
        ids = ids.union(x)
    member = ids.filter(F.size("ids") > 1).distinct().select(F.xxhash64("ids").alias("bucket"), F.size("ids").alias("size"), F.explode("ids").alias("id"))
    full = member.join(nodes, "id").groupBy("bucket", "size").agg(F.collect_list(F.struct("id", "sig")).alias("m"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for m in b.column(0).to_pylist():
                i = np.array([x["id"] for x in m], np.int64)
                found += _forest(i, np.array([x["sig"] for x in m], np.int64).view(np.uint64), distance)
            yield rows_out({k: (pa.int64(), [x[j] for x in found]) for j, k in enumerate(("a", "b"))})

    return by_arrow(full.select("m"), f, "a long, b long", rows=64).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of hashes reach the similarity. Each set of a is read once, those of its b after it."""
    other = pairs.join(sets.select(F.col("id").alias("b"), "hashes"), "b").select("a", "b", "hashes")
    own = sets.join(pairs.select(F.col("a").alias("id")).distinct(), "id").select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "hashes")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, SIGNED)
        for batch in batches:
            found, rows = ([], []), batch.column(2)
            flat, ends = rows.flatten().to_numpy(), np.append(0, np.cumsum(rows.value_lengths().to_numpy()))
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                h = flat[ends[i] : ends[i + 1]]
                if b is None:
                    held = np.sort(h)
                    continue
                common = int(np.count_nonzero(held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h)) if len(held) else 0
                if common >= similarity * (len(held) + len(h) - common) - 1e-9:
                    found[0].append(a)
                    found[1].append(b)
            yield rows_out({"a": (pa.int64(), found[0]), "b": (pa.int64(), found[1])})

    return by_arrow(own.union(other).repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b")), f, "a long, b long")


def _rare_keys(sets: DataFrame, similarity: float) -> DataFrame:
    """(id, size, key, left): of each set the hashes of which two sets of the similarity share one at least, and how many hashes of the set are left from there on, all in the order of how many sets have them.

    Hashes that no other set has come first in that order and are no keys; a set of too many of them has no near copy.
    """
    shared = _shared_keys(sets.select("id", "size", F.explode("hashes").alias("key")))
    listed = shared.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("o"))
    listed = listed.withColumn("more", F.size("o") - F.ceil(F.col("size") * similarity - 1e-9).cast("int") + 1).filter("more > 0")
    keys = listed.select("id", "size", F.size("o").alias("all"), F.expr("posexplode(slice(o, 1, more)) as (at, x)"))
    return keys.select("id", "size", F.col("x.key").alias("key"), F.expr("all - at").alias("left"))


def _candidates(keys: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of different components that share a key and may reach the similarity by their sizes and by what is left from the key on. ``keys`` has component; dense keys are dealt into runs."""
    w = Window.partitionBy("key")
    open_ = keys.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("two", F.min("component").over(w) < F.max("component").over(w)).filter("two")
    met = _in_runs(open_, PART).groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("id", "size", "left", "component")).alias("m")).select("m")
    bound = similarity / (1 + similarity)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, size, left, component = (batch.column(0)[i].values.field(j).to_numpy() for j in range(4))
                for v in range(len(ids) - 1):
                    rest = slice(v + 1, None)
                    u = v + 1 + np.flatnonzero((component[rest] != component[v]) & (np.minimum(left[rest], left[v]) >= bound * (size[rest].astype(np.int64) + size[v]) - 1e-6))
                    if len(u):
                        yield rows_out({"a": (pa.int64(), np.maximum(ids[u], ids[v])), "b": (pa.int64(), np.minimum(ids[u], ids[v]))})

    return by_arrow(met, f, "a long, b long", rows=64).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) per row: 64-bit fingerprints linked at ``distance`` or fewer differing bits.

    component_id is the least doc_id reachable. Null, empty and blank texts have
    the fingerprint 0 and link like any other. Repeated rows each get a row; a
    null id is kept, with the component of its fingerprint. The distance is at
    most 3 with two segments. Other columns are ignored. An empty table gives
    an empty result.
    """
    if distance > 3:
        raise ValueError("two segments find at most 3 differing bits")
    prints = written(fingerprints(docs, id_col, text_col, k), "fingerprints")
    nodes = written(prints.groupBy("sig").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "nodes")
    parts = connected_components(bucket_links(nodes.filter("id is not null").select("id", "sig"), 2, distance))
    of = written(nodes.join(parts, nodes.id == parts.node, "left").select("sig", "n", F.coalesce("component", "id").alias("component_id")), "components")
    return joined(prints, of, "sig", of.agg(F.sum("n")).first()[0] or 0).select("doc_id", F.lpad(F.lower(F.hex(F.col("sig")[0])), 16, "0").alias("fingerprint"), "component_id")


#: What the first document of a group or of equal texts is chosen by: the least id, nulls last, then the text's key.
FIRST = "struct(doc_id is null as none, doc_id, raw)"


def _similar_links(sets: DataFrame, similarity: float, distance: int) -> DataFrame:
    """(a, b): links that connect what all pairs of sets that reach the similarity connect. SimHash comes first; what it leaves apart is compared by shared keys."""
    nodes = sets.select("id", "sig")
    # one node of each signature goes through the buckets; the others are linked to it
    first = nodes.groupBy("sig").agg(F.min("id").alias("id"))
    same = nodes.join(first.withColumnRenamed("id", "b"), "sig").filter("id <> b").select(F.col("id").alias("a"), "b")
    links = written(bucket_links(first, 8, distance).union(same), "links")
    near = written(_similar(links, sets, similarity), "near")
    parts = connected_components(near).select(F.col("node").alias("id"), "component")
    keys = _rare_keys(sets, similarity).join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    pairs = written(_candidates(written(keys, "keys"), similarity).join(links, ["a", "b"], "left_anti"), "pairs")
    return near.union(written(_similar(pairs, sets, similarity), "near"))


def _first_of_groups(docs: DataFrame, id_col: str, text_col: str, k: int, similarity: float, distance: int) -> DataFrame:
    """(doc_id, raw, first) per row: the document that its group keeps, as a struct of ``FIRST``."""
    signed = written(_prefixes(docs, id_col, text_col, k, similarity).withColumn("id", F.monotonically_increasing_id()), "signatures")
    equal = written(signed.groupBy("text_key").agg(F.min(F.expr(FIRST)).alias("first"), F.min("id").alias("id"), F.min("size").alias("size"), F.count(F.lit(1)).alias("n")), "nodes")
    # texts whose prefix shares too few hashes with those of other rows have no near copy
    shared = _shared_keys(signed.select("id", F.explode("prefix").alias("key"))).groupBy("id").agg(F.count(F.lit(1)).alias("common"))
    least = F.floor(F.ceil(F.col("size") * similarity - 1e-9) / SLACK) + 1
    some = equal.join(shared, "id").filter(F.col("common") >= least).select("id", F.col("first.doc_id").alias("i"), F.col("first.raw").alias("raw"))
    some = written(some, "candidates")
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("i"), raw_key(text).alias("raw"), text.alias("text"))
    if some.limit(PICKED + 1).count() <= PICKED:
        rows = rows.join(F.broadcast(some.select("raw").distinct()), "raw", "left_semi")
    texts = rows.join(some.withColumnRenamed("i", "of"), "raw").filter("i <=> of").groupBy("id").agg(F.first("text").alias("text"))
    near = _similar_links(written(_shingle_sets(texts, k), "sets"), similarity, distance)
    groups = equal.join(connected_components(near).withColumnRenamed("node", "id"), "id", "left").select("text_key", "n", "first", "component")
    groups = written(groups, "groups")
    heads = groups.filter("component is not null").groupBy("component").agg(F.min("first").alias("head"))
    of = groups.join(heads, "component", "left").select("text_key", "n", F.coalesce("head", "first").alias("first"))
    return joined(signed.select("doc_id", "raw", "text_key"), written(of, "firsts"), "text_key", groups.agg(F.sum("n")).first()[0] or 0).select("doc_id", "raw", "first")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, distance: int = 26) -> DataFrame:
    """(doc_id, group_id) per row: groups of near copies, group_id being the least doc_id of the group.

    Two documents are linked if the Jaccard similarity of their sets of k-word
    shingles (by 64-bit hashes) reaches the bound, and groups are what all such
    links connect. Texts whose least hashes no other text shares are left out
    first. Of the others, 256-bit word-set signatures within ``distance`` bits
    give the first links, and what they leave apart is compared wherever two sets
    share one of their rarest shingles, as every similar pair does. All links
    are verified on the whole sets.
    Equal texts always share a group; blank and null texts count as equal. Rows
    of one id with different texts are different documents. Null ids are
    documents like others; group_id is null where all of a group are.
    """
    return _first_of_groups(docs, id_col, text_col, k, similarity, distance).select("doc_id", F.col("first.doc_id").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, distance: int = 26) -> DataFrame:
    """The documents, one of each group of near copies, all columns as they are.

    The one that stays has the least id of its group (null ids come last), of
    several texts of that id the one with the least MD5, and of rows that repeat
    both the one that compares least by its other columns. Rows of one id with
    different texts are decided apart. Rules as for ``near_duplicate_groups``.
    """
    groups = _first_of_groups(docs, id_col, text_col, k, similarity, distance)
    stays = groups.filter("doc_id <=> first.doc_id and raw = first.raw").groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("n"))
    stays = written(stays.select(F.col("doc_id").alias("i"), F.col("raw").alias("k"), "n"), "stays")
    rows = docs.select(docs[id_col].cast("long").alias("i"), raw_key(docs[text_col].cast("string")).alias("k"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    on = lambda a, b: a["i"].eqNullSafe(b["i"]) & (a["k"] == b["k"])
    once, many = stays.filter("n = 1"), stays.filter("n > 1")
    single = rows.join(once, on(rows, once), "left_semi").select("row.*")
    repeated = rows.join(many, on(rows, many), "left_semi")
    order = F.struct(F.to_json("row"), F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")))
    return single.unionByName(repeated.groupBy("i", "k").agg(F.min_by("row", order).alias("row")).select("row.*"))
