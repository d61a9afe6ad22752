"""Queries of retrieval and evidence: index, search, fusion, reranking, merging, gates, rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.config import DEFAULT
from textmill.functions import text as tx
from textmill.operators import dense, fuse, lexical
from textmill.plans.registry import Tables, query
from textmill.plans.text_queries import TOK

INDEX = f"""tk as (select doc_id, {TOK} as t from documents), tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from tk) group by all),
dl as (select doc_id, len(t) as dl from tk), st as (select count(*) as n_docs, avg(dl) as avg_dl from dl), df as (select term, count(*) as df from tf group by term)"""
QT = f"qt as (select item_id, term, count(*) as qtf from (select item_id, unnest({TOK}) as term from benchmark) group by all)"
SCORES = f"""{INDEX}, {QT}, sc as (select item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) as score
from qt join tf using (term) join df using (term) join dl using (doc_id), st group by item_id, doc_id)"""


def _hits_sql(k: int) -> str:
    return f"{SCORES}, hits as (select * from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rnk from sc where score > 0) where rnk <= {k})"


def hits(t: Tables, k: int) -> DataFrame:
    """BM25 hits of the benchmark passages in the stored index."""
    if "evidence" in t.pinned:
        return t.pinned["evidence"].filter(F.col("rnk") <= k).select("item_id", "doc_id", "score", "rnk")
    return t.index.top_k(lexical.query_terms(t.benchmark), k)


@query(f"with {INDEX} select term, df::bigint as df from df")
def bm25_df(t: Tables) -> DataFrame:
    """Document frequencies."""
    return t.index.frequency()


@query(f"with {_hits_sql(10)} select item_id, doc_id, score, rnk::int as rnk from hits")
def bm25_topk(t: Tables) -> DataFrame:
    """Ten best documents for each passage."""
    return hits(t, 10).select("item_id", "doc_id", "score", "rnk")


@query(f"with {INDEX} select term, round(case when (n_docs - df + 0.5) / (df + 0.5) <= 0 then 1e-6 else ln(1 + (n_docs - df + 0.5) / (df + 0.5)) + 0.1 end, 6) as weight from df, st")
def idf_weights(t: Tables) -> DataFrame:
    """Coverage weights of all terms."""
    df = t.index.frequency().crossJoin(F.broadcast(t.index.stats()))
    return df.select("term", F.round(lexical.idf_weight(F.col("df"), F.col("n_docs")), 6).alias("weight"))


VEC = """vt as (select {id} as id, t, count(*) as n from (select {id}, unnest({tok}) as t from {table}) group by all),
vb as (select id, ('0x' || substr(md5(t), 1, 8))::bigint % 256 as bucket, sum((case when ('0x' || substr(md5(t), 10, 1))::int % 2 = 1 then 1 else -1 end) * (1 + ln(n))) as v from vt group by all),
vw as (select id, bucket, v / sqrt(sum(v * v) over (partition by id)) as w from vb where v <> 0)"""


@query("with " + VEC.format(id="item_id", tok=TOK, table="benchmark") + " select id, bucket::bigint as bucket, round(w, 6) as w from vw")
def sparse_embed(t: Tables) -> DataFrame:
    """Hashed unit vectors of the passages."""
    return dense.hashed_vectors(t.benchmark, "item_id").select("id", "bucket", F.round("w", 6).alias("w"))


DENSE = "vs as (select q.vec_id as qid, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0), dt as (select * from (select *, row_number() over (partition by qid order by score desc, vec_id) as rnk from vs where score > 0) where rnk <= 10)"


@query(f"with {DENSE} select qid, vec_id, score, rnk::int as rnk from dt")
def dense_topk(t: Tables) -> DataFrame:
    """Ten nearest vectors of every fiftieth one."""
    return dense.vector_top_k(t.embeddings.filter("vec_id % 50 = 0"), t.embeddings, 10)


@query()
def ann_cells_topk(t: Tables) -> DataFrame:
    """Approximate search in the stored index: ten nearest of every fiftieth vector, with the codes and vectors that it looked at."""
    return t.vector_index.search(t.embeddings.filter("vec_id % 50 = 0"), 10).withColumnRenamed("id", "vec_id")


@query("select q.vec_id as qid, v.label, round(max(list_cosine_similarity(q.embedding::double[], v.embedding::double[])), 6) as best from embeddings q, embeddings v where v.vec_id <> q.vec_id group by all")
def cosine_pairs(t: Tables) -> DataFrame:
    """Best cosine of every vector per label, as intents match prototypes."""
    return dense.label_max(t.embeddings, t.embeddings).select("qid", "label", F.round("score", 6).alias("best"))


TERMS = "item_id, doc_id, rnk, score"


def overlap_channel(t: Tables, k: int) -> DataFrame:
    """Second channel: documents by how many of the query's distinct terms they hold."""
    return t.index.overlap_top_k(lexical.query_terms(t.benchmark), k)


OVERLAP = "ov as (select * from (select item_id, doc_id, count(*) as score, row_number() over (partition by item_id order by count(*) desc, doc_id) as rnk from qt join tf using (term) group by item_id, doc_id) where rnk <= 24)"
RRF = f"with {_hits_sql(24)}, {OVERLAP}, ch as (select item_id, doc_id, rnk, 1.0 as w from hits union all select item_id, doc_id, rnk, 0.5 from ov), rr as (select item_id, doc_id, round(sum(w / (60 + rnk)), 9) as score from ch group by all), rf as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rnk from rr)"


def fused(t: Tables) -> DataFrame:
    """Both channels of 24 fused."""
    a = hits(t, DEFAULT.top_k * DEFAULT.pool_factor).select("item_id", "doc_id", "rnk", F.lit(1.0).alias("weight"))
    b = overlap_channel(t, DEFAULT.top_k * DEFAULT.pool_factor).select("item_id", "doc_id", "rnk", F.lit(0.5).alias("weight"))
    return fuse.rrf(a.unionByName(b))


@query(f"{RRF} select item_id, doc_id, score, rnk::int as rnk from rf where rnk <= 8")
def rrf_fusion(t: Tables) -> DataFrame:
    """Eight best of the fused channels."""
    return fused(t).filter("rnk <= 8").select("item_id", "doc_id", "score", "rnk")


DENSE_TEXT = VEC.format(id="item_id", tok=TOK, table="benchmark").replace("vt", "qvt").replace("vb", "qvb").replace("vw", "qvw") + ", " + VEC.format(id="doc_id", tok=TOK, table="documents") + """,
dn as (select qvw.id as item_id, vw.id as doc_id, round(sum(qvw.w * vw.w), 6) as score from qvw join vw using (bucket) group by all),
de as (select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rnk from dn where score > 0) where rnk <= 24)"""


def dense_hits(t: Tables, k: int) -> DataFrame:
    """(item_id, doc_id, score, rnk): documents by the cosine of hashed vectors of whole texts."""
    q = dense.packed(dense.hashed_vectors(t.benchmark, "item_id")).withColumnRenamed("id", "item_id")
    d = dense.counted_vectors(t.index.forward())
    return dense.vector_top_k(q, d, k, "item_id", "doc_id", other=False).withColumnRenamed("qid", "item_id")


def search(t: Tables, mode: str, k: int = DEFAULT.top_k) -> DataFrame:
    """(item_id, doc_id, score, rnk, degraded) of one mode. A single channel keeps its raw scores, hybrid fuses pools of both; without a channel there is a row per passage that says so."""
    pool = k * DEFAULT.pool_factor
    if mode == "none":
        return t.benchmark.select("item_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rnk"), F.lit("NO_CHANNEL_ENABLED").alias("degraded"))
    if mode not in ("hybrid", "dense", "sparse"):
        raise ValueError(f"no such mode: {mode}")
    channels = [f(t, pool).select("item_id", "doc_id", F.col("score").cast("double").alias("score"), "rnk") for name, f in (("dense", dense_hits), ("sparse", hits)) if mode in (name, "hybrid")]
    ranked = channels[0] if len(channels) == 1 else fuse.rrf(channels[0].unionByName(channels[1]).withColumn("weight", F.lit(1.0)))
    return ranked.filter(F.col("rnk") <= k).select("item_id", "doc_id", "score", "rnk", F.lit(None).cast("string").alias("degraded"))


@query(f"""with {_hits_sql(24)}, {DENSE_TEXT}, hc as (select item_id, doc_id, round(sum(1.0::double / (60 + rnk)), 9) as score from (select item_id, doc_id, rnk from hits union all select item_id, doc_id, rnk from de) group by all),
hy as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rnk from hc)
select 'sparse' as mode, item_id, doc_id, score::double as score, rnk::int as rnk, null::varchar as degraded from hits where rnk <= 8 union all select 'dense', item_id, doc_id, score::double, rnk::int, null from de where rnk <= 8 union all select 'hybrid', item_id, doc_id, score::double, rnk::int, null from hy where rnk <= 8
union all select 'none', item_id, null, null, null, 'NO_CHANNEL_ENABLED' from benchmark""")
def search_modes(t: Tables) -> DataFrame:
    """The search in each of its modes."""
    out = None
    for mode in ("sparse", "dense", "hybrid", "none"):
        rows = search(t, mode).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"with {_hits_sql(10)}, {OVERLAP}, u as (select item_id, doc_id, score, 1 as agent from hits union all select item_id, doc_id, score, 2 from ov), f as (select * from (select *, row_number() over (partition by item_id, doc_id order by agent) as n from u) where n = 1) select item_id, doc_id, agent::int as agent, score::double as score, row_number() over (partition by item_id order by score desc, doc_id)::int as pos from f")
def merged_evidence(t: Tables) -> DataFrame:
    """Evidence of two agents as one list: the first agent's record of a document wins, then by score."""
    u = hits(t, 10).select("item_id", "doc_id", F.col("score").cast("double").alias("score"), F.lit(1).alias("agent"))
    u = u.unionByName(overlap_channel(t, 24).select("item_id", "doc_id", F.col("score").cast("double").alias("score"), F.lit(2).alias("agent")))
    first = u.groupBy("item_id", "doc_id").agg(F.min("agent").alias("agent"), F.min_by("score", "agent").alias("score"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))


@query(f"with {_hits_sql(10)} select item_id, doc_id, round(case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 1.0 end, 6) as norm from hits window w as (partition by item_id)")
def minmax_scores(t: Tables) -> DataFrame:
    """Scores of the hits from 0 to 1."""
    return fuse.minmax(hits(t, 10)).select("item_id", "doc_id", "norm")


@query(f"with {_hits_sql(10)}, {OVERLAP}, u as (select item_id, doc_id, score, rnk from hits union all select item_id, doc_id, score, rnk from ov) select item_id, doc_id, max(score)::double as score, min(rnk)::int as pos from u group by all")
def union_hits(t: Tables) -> DataFrame:
    """Hits of two searches as one list."""
    a = hits(t, 10).select("item_id", "doc_id", "score", "rnk")
    return fuse.union_max(a.unionByName(overlap_channel(t, 24).select("item_id", "doc_id", F.col("score").cast("double").alias("score"), "rnk")))


QW = f"qw as (select item_id, list_distinct({TOK}) as q, array_to_string({TOK}, ' ') as qs from benchmark)"


#: Hits of a passage in any list that texts are joined to.
POOL = 2 * DEFAULT.top_k * DEFAULT.pool_factor


def with_text(t: Tables, h: DataFrame) -> DataFrame:
    """Hits with the texts of document and query. The documents side isn't shuffled while the hits are few by count."""
    q = t.benchmark.select("item_id", tx.tokens(F.col("text")).alias("qt"))
    q = q.select("item_id", F.array_distinct("qt").alias("q"), F.array_join("qt", " ").alias("qs"))
    few = t.benchmark.count() * POOL <= lexical.BROADCAST_ROWS  # a passage has that many hits at most, so nothing is searched twice to count them
    return t.documents.select("doc_id", "text", "source").join(lexical.hinted(h, few), "doc_id").join(lexical.hinted(q, few), "item_id")


def evidence(t: Tables, k: int) -> DataFrame:
    """The k best hits with their texts."""
    if "evidence" in t.pinned:
        return t.pinned["evidence"].filter(F.col("rnk") <= k)
    return with_text(t, hits(t, k))


def covered(q: object, toks: object) -> object:
    """Share of the query's term weight (length) that the tokens cover."""
    weigh = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    return F.when(F.size(q) > 0, weigh(F.array_intersect(q, toks)) / weigh(q)).otherwise(0.0)


LEX = "round(least(coalesce(list_sum(list_transform(list_filter(q, lambda x: list_contains(tk.t, x)), lambda x: length(x))) / list_sum(list_transform(q, lambda x: length(x))), 0) + case when length(qs) >= 4 and contains(text, qs) then 0.1 else 0 end, 1.0), 6)"


def reranked(t: Tables, limit: int = 20) -> DataFrame:
    """The first ``limit`` fused hits by lexical score; the tail keeps its order with score 0."""
    f = fused(t)
    head = with_text(t, f.filter(F.col("rnk") <= limit))
    score = covered(F.col("q"), tx.tokens(F.col("text"))) + F.when((F.length("qs") >= 4) & F.contains("text", "qs"), 0.1).otherwise(0.0)
    scored = head.select("item_id", "doc_id", "rnk", F.round(F.least(score, F.lit(1.0)), 6).alias("lex"), F.lit(0).alias("tail"))
    tail = f.filter(F.col("rnk") > limit).select("item_id", "doc_id", "rnk", F.lit(0.0).alias("lex"), F.lit(1).alias("tail"))
    order = [F.col("tail"), F.desc("lex"), F.when(F.col("tail") == 1, F.col("rnk")).otherwise(0), F.col("doc_id")]
    return scored.unionByName(tail).withColumn("pos", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))


RERANK = f"{RRF}, {QW}, hd as (select rf.item_id, rf.doc_id, rf.rnk, {LEX} as lex, 0 as tail from rf join documents using (doc_id) join tk using (doc_id) join qw using (item_id) where rf.rnk <= 20), al as (select * from hd union all select item_id, doc_id, rnk, 0.0, 1 from rf where rnk > 20), re as (select *, row_number() over (partition by item_id order by tail, lex desc, case when tail = 1 then rnk else 0 end, doc_id) as pos from al)"


@query(f"{RERANK} select item_id, doc_id, lex::double as lex, pos::int as pos from re")
def lexical_rerank(t: Tables) -> DataFrame:
    """Bounded rerank by covered term weight."""
    return reranked(t).select("item_id", "doc_id", "lex", "pos")


PARENT = "pa as (select source, min(doc_id) as parent from documents group by source), pt as (select pa.source, pa.parent, length(text) as plen from pa join documents d on d.doc_id = pa.parent)"


def _parents(t: Tables) -> DataFrame:
    """One parent per source: its first document, with the length of its text."""
    return t.documents.groupBy("source").agg(F.min(F.struct("doc_id", F.length("text").alias("n"))).alias("p")).select("source", F.col("p.doc_id").alias("parent"), F.col("p.n").alias("plen"))


@query(f"with {_hits_sql(8)}, {PARENT} select item_id, doc_id, rnk::int as rnk, case when count(*) over (partition by item_id, d.source) >= 2 and plen > length(text) then 'parent' else 'leaf' end as merge_source, case when count(*) over (partition by item_id, d.source) >= 2 and plen > length(text) then plen else length(text) end::bigint as context_chars from hits join documents d using (doc_id) join pt using (source)")
def expand_merge(t: Tables) -> DataFrame:
    """Hits that share a parent with another hit get the parent's text if it is longer; order and ids stay."""
    h = evidence(t, 8).join(_parents(t), "source")
    n = F.count(F.lit(1)).over(Window.partitionBy("item_id", "source"))
    up = (F.col("n") >= DEFAULT.merge_threshold) & (F.col("plen") > F.length("text"))
    return h.withColumn("n", n).select("item_id", "doc_id", "rnk", F.when(up, "parent").otherwise("leaf").alias("merge_source"), F.when(up, F.col("plen")).otherwise(F.length("text")).cast("long").alias("context_chars"))


@query(f"with {_hits_sql(8)}, {PARENT}, g as (select item_id, parent, max(score) as score, min(rnk) as pos, count(*) as n, min(doc_id) as lone from hits join documents d using (doc_id) join pt using (source) group by item_id, parent), o as (select item_id, parent as unit, score, pos, n from g where n >= 2 union all select h.item_id, h.doc_id, h.score, h.rnk, 1 from hits h join documents d using (doc_id) join pt using (source) join g on g.item_id = h.item_id and g.parent = pt.parent and g.n < 2) select item_id, unit, score, n::bigint as n, row_number() over (partition by item_id order by pos)::int as pos from o")
def replace_merge(t: Tables) -> DataFrame:
    """Groups of hits under one parent become the parent: best score, first position."""
    h = evidence(t, 8).join(_parents(t), "source")
    g = h.groupBy("item_id", "parent").agg(F.max("score").alias("score"), F.min("rnk").alias("pos"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lone"))
    unit = F.when(F.col("n") >= DEFAULT.merge_threshold, F.col("parent")).otherwise(F.col("lone"))
    return g.select("item_id", unit.alias("unit"), "score", "n", F.row_number().over(Window.partitionBy("item_id").orderBy("pos")).alias("pos"))


@query(f"""with recursive {_hits_sql(8)}, u as (select item_id, doc_id, rnk, length(text)::bigint as n from hits join documents using (doc_id)),
p as (select item_id, 0::bigint as rnk, 0::bigint as used, 0 as taken, null::bigint as doc_id, false as keep from (select distinct item_id from u) union all
select u.item_id, u.rnk, case when p.used + u.n + 120 <= 12000 then p.used + u.n + 120 when u.rnk = 1 then 12000 else p.used end, p.taken + case when p.used + u.n + 120 <= 12000 or u.rnk = 1 then 1 else 0 end, u.doc_id, p.used + u.n + 120 <= 12000 or u.rnk = 1 from p join u on u.item_id = p.item_id and u.rnk = p.rnk + 1)
select item_id, doc_id, rnk::int as rnk, used from p where keep""")
def greedy_pack(t: Tables) -> DataFrame:
    """Evidence packed into 12 000 characters."""
    return fuse.pack(evidence(t, 8).select("item_id", "doc_id", "rnk", F.length("text").alias("n")))


SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?；;.\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
STOK = r"regexp_extract_all(lower(s), '[a-z][a-z0-9_\-]+')"
SSCORE = rf"case when len({STOK}) = 0 then 0.0 else len(list_filter(q, lambda x: list_contains({STOK}, x))) + (case when regexp_matches(s, '[0-9]') then 0.35 else 0 end) + (case when length(s) between 18 and 120 then 0.1 else 0 end) end"


def scored_sentences(t: Tables, k: int) -> DataFrame:
    """Sentences of the k best hits with their score and place."""
    h = evidence(t, k).select("item_id", "doc_id", "rnk", "q", F.length("text").alias("n"), F.posexplode(tx.sentences(F.col("text"), "。！？!?；;.\n")).alias("i", "s"))
    toks = tx.tokens(F.col("s"))
    score = F.size(F.array_intersect("q", toks)) + F.when(F.col("s").rlike("[0-9]"), 0.35).otherwise(0.0) + F.when(F.length("s").between(18, 120), 0.1).otherwise(0.0)
    return h.withColumn("score", F.when(F.size(toks) == 0, 0.0).otherwise(score))


@query(f"""with {_hits_sql(3)}, {QW}, s as (select item_id, doc_id, length(text) as n, q, unnest({SENT}) as s, generate_subscripts({SENT}, 1) as i from hits join documents using (doc_id) join qw using (item_id)),
r as (select *, row_number() over (partition by item_id, doc_id order by {SSCORE} desc, i) as rn from s)
select item_id, doc_id, case when length(string_agg(s, ' ' order by i)) < any_value(n) then md5(string_agg(s, ' ' order by i)) else 'original' end as digest, count(*)::bigint as kept from r where rn <= 3 group by item_id, doc_id""")
def compress_sentences(t: Tables) -> DataFrame:
    """Three best sentences of each hit in their order, if that is shorter."""
    w = Window.partitionBy("item_id", "doc_id").orderBy(F.desc("score"), "i")
    top = scored_sentences(t, 3).withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    g = top.groupBy("item_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x.s), " ").alias("s"), F.first("n").alias("n"), F.count(F.lit(1)).alias("kept"))
    return g.select("item_id", "doc_id", F.when(F.length("s") < F.col("n"), F.md5("s")).otherwise("original").alias("digest"), "kept")


@query(f"""with {_hits_sql(3)}, {QW}, s as (select item_id, doc_id, rnk, q, unnest({SENT}) as s, generate_subscripts({SENT}, 1) as i from hits join documents using (doc_id) join qw using (item_id)),
r as (select *, len(list_filter(q, lambda x: list_contains({STOK}, x))) as hit, row_number() over (partition by item_id, doc_id order by len(list_filter(q, lambda x: list_contains({STOK}, x))) desc, i) as rn from s)
select item_id, md5(string_agg(s || '[' || rnk || ']', '' order by rnk)) as digest, sum(hit)::bigint as hits from r where rn = 1 group by item_id""")
def extractive_answer(t: Tables) -> DataFrame:
    """The best sentence of each of the three best hits, cited."""
    s = scored_sentences(t, 3).withColumn("hit", F.size(F.array_intersect("q", tx.tokens(F.col("s")))))
    w = Window.partitionBy("item_id", "doc_id").orderBy(F.desc("hit"), "i")
    best = s.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "s"))), lambda x: F.concat(x.s, F.lit("["), x.rnk.cast("string"), F.lit("]"))), "")
    return best.groupBy("item_id").agg(F.md5(text).alias("digest"), F.sum("hit").alias("hits"))


@query(f"with {_hits_sql(8)} select item_id, rnk::int as n, '[' || rnk || '] ' || source || ' (' || doc_id || ')' as header from hits join documents using (doc_id)")
def evidence_numbering(t: Tables) -> DataFrame:
    """Numbered evidence headers."""
    h = evidence(t, 8)
    return h.select("item_id", F.col("rnk").alias("n"), F.concat(F.lit("["), F.col("rnk").cast("string"), F.lit("] "), "source", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")")).alias("header"))


COVER = f"""{_hits_sql(8)}, {QW}, ww as (select item_id, term, length(term) * case when df is null then 1.5 when (n_docs - df + 0.5) / (df + 0.5) <= 0 then 1e-6 else ln(1 + (n_docs - df + 0.5) / (df + 0.5)) + 0.1 end as w from (select item_id, unnest(q) as term from qw) left join df using (term), st),
hv as (select ww.item_id, doc_id, term, w from ww join hits using (item_id) join tf using (doc_id, term)),
tot as (select item_id, sum(w) as total, count(*) as n from ww group by item_id),
bst as (select item_id, max(c) as best from (select item_id, doc_id, sum(w) as c from hv group by all) group by item_id),
un as (select item_id, sum(w) as c from (select distinct item_id, term, w from hv) group by item_id),
cv as (select tot.item_id, round(coalesce(best, 0) / total, 6) as relevance, round(coalesce(un.c, 0) / total, 6) as coverage from tot left join bst using (item_id) left join un using (item_id))"""


def weighed_terms(t: Tables) -> DataFrame:
    """(item_id, term, w): distinct query terms with length times rarity."""
    if "weights" in t.pinned:
        return t.pinned["weights"]
    q = t.benchmark.select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    return q.join(t.index.frequency(), "term", "left").crossJoin(F.broadcast(t.index.stats())).select("item_id", "term", (F.length("term") * lexical.idf_weight(F.col("df"), F.col("n_docs"))).alias("w"))


def coverage(t: Tables) -> DataFrame:
    """(item_id, relevance, coverage): best single hit and union of the hits over the query's weight."""
    ww = weighed_terms(t)
    terms = evidence(t, 8).select("item_id", "doc_id", F.explode(F.array_intersect("q", tx.tokens(F.col("text")))).alias("term"))
    hv = terms.join(ww, ["item_id", "term"])
    best = hv.groupBy("item_id", "doc_id").agg(F.sum("w").alias("c")).groupBy("item_id").agg(F.max("c").alias("best"))
    union = hv.select("item_id", "term", "w").distinct().groupBy("item_id").agg(F.sum("w").alias("c"))
    total = ww.groupBy("item_id").agg(F.sum("w").alias("total"))
    share = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) / F.col("total"), 6)
    return total.join(best, "item_id", "left").join(union, "item_id", "left").select("item_id", share("best").alias("relevance"), share("c").alias("coverage"))


@query(f"with {COVER} select item_id, relevance, coverage, case when relevance >= 0.5 then 'answer' when coverage < 0.12 then 'clarify' else 'rewrite' end as route from cv")
def grade_route(t: Tables) -> DataFrame:
    """Evidence grade and route."""
    route = F.when(F.col("relevance") >= DEFAULT.answerable, "answer").when(F.col("coverage") < DEFAULT.ambiguous, "clarify").otherwise("rewrite")
    return coverage(t).withColumn("route", route)


FOCUS = f"{COVER}, fo as (select item_id, term, row_number() over (partition by item_id order by length(term) desc, term) as rn from ww where length(term) >= 2), fc as (select item_id, count(*) filter (where exists (select 1 from hv where hv.item_id = fo.item_id and hv.term = fo.term)) / count(*) as focus, count(*) as n from fo where rn <= 12 group by item_id)"


def sufficiency_table(t: Tables) -> DataFrame:
    """(item_id, coverage, focus, sufficient)."""
    ww = weighed_terms(t)
    w = Window.partitionBy("item_id").orderBy(F.desc(F.length("term")), "term")
    focus = ww.filter("length(term) >= 2").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= DEFAULT.focus_terms)
    seen = evidence(t, 8).select("item_id", F.explode(F.array_intersect("q", tx.tokens(F.col("text")))).alias("term")).distinct().withColumn("seen", F.lit(1))
    f = focus.join(seen, ["item_id", "term"], "left").groupBy("item_id").agg(F.round(F.avg(F.coalesce("seen", F.lit(0))), 6).alias("focus"))
    c = coverage(t).select("item_id", "coverage").join(f, "item_id", "left").withColumn("focus", F.coalesce("focus", F.lit(0.0)))
    return c.withColumn("sufficient", (F.col("coverage") >= DEFAULT.coverage) & (F.col("focus") >= DEFAULT.focus_coverage))


@query(f"with {FOCUS} select item_id, coverage, round(coalesce(focus, 0), 6) as focus, coverage >= 0.5 and coalesce(focus, 0) >= 0.5 as sufficient from cv left join fc using (item_id)")
def sufficiency(t: Tables) -> DataFrame:
    """Whether evidence suffices: weighted coverage and focus terms."""
    return sufficiency_table(t)


CLAIMS = rf"""cl as (select item_id, unnest({SENT}) as s, generate_subscripts({SENT}, 1) as i from benchmark),
cs as (select *, list_distinct({STOK}) as toks, case when i % 2 = 1 then i else null end as cite from cl)"""


@query(f"""with {_hits_sql(8)}, {CLAIMS}, ev as (select c.item_id, c.i, c.s, c.toks, c.cite, h.rnk, case when len(c.toks) = 0 then 1.0 else len(list_filter(c.toks, lambda x: list_contains(tk.t, x))) / len(c.toks) end as sup from cs c left join hits h on h.item_id = c.item_id left join tk using (doc_id))
select item_id, i::int as n, any_value(cite)::int as cite, case when any_value(cite) is not null then coalesce(max(sup) filter (where rnk = cite), 0) >= 0.3 else length(any_value(s)) <= 12 or coalesce(max(sup), 0) >= 0.5 end as supported from ev group by item_id, i""")
def claim_support(t: Tables) -> DataFrame:
    """Claims (the sentences of a passage; odd ones cite the evidence of their number): cited ones need 0.3 of their tokens there, others 0.5 in any block."""
    c = t.benchmark.select("item_id", F.posexplode(tx.sentences(F.col("text"), "。！？!?；;.\n")).alias("p", "s"))
    c = c.select("item_id", (F.col("p") + 1).alias("n"), "s", F.array_distinct(tx.tokens(F.col("s"))).alias("toks")).withColumn("cite", F.when(F.col("n") % 2 == 1, F.col("n")))
    e = evidence(t, 8).select("item_id", "rnk", tx.tokens(F.col("text")).alias("t"))
    sup = F.when(F.size("toks") == 0, 1.0).otherwise(F.size(F.array_intersect("toks", "t")) / F.size("toks"))
    j = c.join(e, "item_id", "left").withColumn("sup", sup)
    g = j.groupBy("item_id", "n").agg(F.first("cite").alias("cite"), F.first("s").alias("s"), F.coalesce(F.max(F.when(F.col("rnk") == F.col("cite"), F.col("sup"))), F.lit(0.0)).alias("own"), F.coalesce(F.max("sup"), F.lit(0.0)).alias("any"))
    ok = F.when(F.col("cite").isNotNull(), F.col("own") >= DEFAULT.cited_support).otherwise((F.length("s") <= DEFAULT.free_chars) | (F.col("any") >= DEFAULT.uncited_support))
    return g.select("item_id", "n", "cite", ok.alias("supported"))


@query(f"with {FOCUS} select item_id, case when not exists (select 1 from hits where hits.item_id = cv.item_id) then 'abstain' when not (coverage >= 0.5 and coalesce(focus, 0) >= 0.5) then 'abstain' when relevance < 0.5 then 'regenerate' else 'pass' end as verdict from cv left join fc using (item_id)")
def verdicts(t: Tables) -> DataFrame:
    """Verdict by priority: no evidence, insufficient, weak answer, pass. Evidence and term weights are made once."""
    if not t.pinned:
        t.pin("evidence", evidence(t, 8))
        t.pin("weights", weighed_terms(t))
    s = sufficiency_table(t).join(coverage(t).select("item_id", "relevance"), "item_id")
    some = hits(t, 8).select("item_id").distinct().withColumn("some", F.lit(True))
    v = F.when(F.col("some").isNull(), "abstain").when(~F.col("sufficient"), "abstain").when(F.col("relevance") < DEFAULT.answerable, "regenerate").otherwise("pass")
    return s.join(some, "item_id", "left").select("item_id", v.alias("verdict"))


@query(r"select conv_id, turn, (len(regexp_extract_all(text, '[?？]')) >= 2 or length(text) >= 60) as complex, '请综合回答：' || regexp_replace(substr(text, 1, 40), '\s+', ' ', 'g') as step_back from conversations where role = 'user'")
def query_complexity(t: Tables) -> DataFrame:
    """Complex questions, and a wider rewrite of each."""
    u = t.conversations.filter("role = 'user'")
    return u.select("conv_id", "turn", tx.complex_question(F.col("text")).alias("complex"), F.concat(F.lit("请综合回答："), F.regexp_replace(F.substr("text", F.lit(1), F.lit(40)), r"\s+", " ")).alias("step_back"))


UNKNOWN = rf"uk as (select distinct term from (select unnest({TOK}) as term from conversations where role = 'user') where term not in (select term from df))"


@query(f"with {INDEX}, {UNKNOWN} select uk.term, min(df.term) as first_neighbour, count(*)::bigint as n from uk join df on length(uk.term) >= 2 and length(df.term) >= 2 and abs(length(uk.term) - length(df.term)) <= 1 and levenshtein(uk.term, df.term) <= 1 group by uk.term")
def oov_neighbors(t: Tables) -> DataFrame:
    """Unknown words of user turns with known ones within one edit."""
    known = t.index.frequency().select("term")
    used = t.conversations.filter("role = 'user'").select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    n = lexical.neighbours(used.join(known, "term", "left_anti"), known)
    return n.groupBy("term").agg(F.min("neighbour").alias("first_neighbour"), F.count(F.lit(1)).alias("n"))


@query(f"""with {INDEX}, u as (select conv_id, turn, unnest(list_distinct({TOK})) as term from conversations where role = 'user'), tot as (select greatest(sum(df), 1) as total from df),
g as (select conv_id, turn, count(*) as n, count(*) filter (where df is null) as oov, count(*) filter (where df between 1 and 2) as rare, count(*) filter (where coalesce(df, 0) / total >= 0.3) as generic from u left join df using (term), tot group by conv_id, turn)
select conv_id, turn, oov / n >= 0.4 as alias_defect, rare >= 3 or (rare >= 2 and n <= 8) as too_narrow, n <= 3 and generic = n as too_broad from g""")
def query_defects(t: Tables) -> DataFrame:
    """Defects of user turns by document frequencies."""
    df = t.index.frequency()
    u = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    total = df.agg(F.greatest(F.sum("df"), F.lit(1)).alias("total"))
    g = u.join(df, "term", "left").crossJoin(F.broadcast(total)).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("df").isNull()).alias("oov"), F.count_if(F.col("df").between(1, 2)).alias("rare"), F.count_if(F.coalesce("df", F.lit(0)) / F.col("total") >= 0.3).alias("generic"))
    return g.select("conv_id", "turn", (F.col("oov") / F.col("n") >= 0.4).alias("alias_defect"), ((F.col("rare") >= 3) | ((F.col("rare") >= 2) & (F.col("n") <= 8))).alias("too_narrow"), ((F.col("n") <= 3) & (F.col("generic") == F.col("n"))).alias("too_broad"))


@query()
def sub_questions(t: Tables) -> DataFrame:
    """User turns split at conjunctions and question marks, four parts at most."""
    u = t.conversations.filter("role = 'user'")
    parts = F.filter(F.transform(F.split("text", "[?？;；]|，以及|，并且|, and "), lambda x: F.trim(x)), lambda x: F.length(x) >= 4)
    return u.select("conv_id", "turn", F.posexplode(F.slice(parts, 1, 4)).alias("n", "question"))
