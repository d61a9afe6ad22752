"""Queries of evaluation and of what it feeds: metrics, slices, intervals, failures, review, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions import text as tx
from textmill.operators import dense, evaluate, lexical
from textmill.plans.registry import Tables, query
from textmill.plans.retrieval_queries import _hits_sql, hits, overlap_channel, with_text
from textmill.plans.text_queries import TOK, containing

JUDGED = f"{_hits_sql(10)}, ju as (select h.item_id, h.doc_id, h.rnk, d.source, contains(d.text, b.text) as hit from hits h join documents d using (doc_id) join benchmark b using (item_id))"
CASES = f"""{JUDGED}, cg as (select item_id, count(*) filter (where hit) as n, least(count(*) filter (where hit and rnk <= 1), 1) as r1, least(count(*) filter (where hit and rnk <= 3), 1) as r3, least(count(*) filter (where hit and rnk <= 5), 1) as r5, least(count(*) filter (where hit), 1) as r10, coalesce(1.0 / min(rnk) filter (where hit), 0) as mrr, coalesce(sum(case when hit then 1 / log2(rnk + 1) end), 0) as dcg from ju group by item_id),
cs as (select item_id, coalesce(r1, 0)::double as recall_1, coalesce(r3, 0)::double as recall_3, coalesce(r5, 0)::double as recall_5, coalesce(r10, 0)::double as recall_10, coalesce(mrr, 0)::double as mrr, coalesce(case when n > 0 then dcg / (select sum(1 / log2(i + 1)) from generate_series(1, n) s(i)) else 0 end, 0)::double as ndcg from benchmark left join cg using (item_id))"""


def judged(t: Tables) -> DataFrame:
    """Ten hits per passage, with whether the document contains the passage."""
    gold = t.benchmark.select("item_id", F.col("text").alias("gold"))
    h = with_text(t, hits(t, 10)).join(lexical.small(gold), "item_id")
    return h.select("item_id", "doc_id", "rnk", "source", F.contains("text", "gold").alias("hit"))


@query(f"with {CASES} select item_id, recall_1, recall_3, recall_5, recall_10, round(mrr, 6) as mrr, round(ndcg, 6) as ndcg from cs")
def case_metrics(t: Tables) -> DataFrame:
    """Retrieval metrics per passage."""
    c = evaluate.case_scores(judged(t), t.benchmark)
    return c.select("item_id", "recall_1", "recall_3", "recall_5", "recall_10", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


@query(f"with {CASES} select count(*)::bigint as eligible, round(avg(recall_1), 6) as recall_1, round(avg(recall_5), 6) as recall_5, round(avg(recall_10), 6) as recall_10, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg from cs")
def retrieval_run(t: Tables) -> DataFrame:
    """Means over all passages."""
    c = evaluate.case_scores(judged(t), t.benchmark)
    return c.agg(F.count(F.lit(1)).alias("eligible"), *(F.round(F.avg(x), 6).alias(x) for x in ("recall_1", "recall_5", "recall_10", "mrr", "ndcg")))


@query("select d.doc_id, b.item_id from documents d, benchmark b where contains(d.text, b.text)")
def gold_containment(t: Tables) -> DataFrame:
    """Documents that contain a passage verbatim."""
    gold = t.benchmark.select("item_id", F.col("text").alias("gold"))
    return containing(t.documents.select("doc_id", "text"), gold, "text", "gold").select("doc_id", "item_id")


@query(f"with {JUDGED}, g as (select distinct b.item_id, d.source from documents d, benchmark b where contains(d.text, b.text)), s as (select item_id, source, row_number() over (partition by item_id order by min(rnk)) as rn from ju group by item_id, source) select g.item_id, round(avg(case when s.rn <= 3 then 1.0 else 0 end), 6) as recall_3, round(avg(case when s.rn <= 5 then 1.0 else 0 end), 6) as recall_5 from g left join s using (item_id, source) group by g.item_id")
def document_recall(t: Tables) -> DataFrame:
    """Recall of gold sources after removing repeated ones in order, before the cut."""
    gold = containing(t.documents.select("doc_id", "text", "source"), t.benchmark.select("item_id", F.col("text").alias("gold")), "text", "gold").select("item_id", "source").distinct()
    s = judged(t).groupBy("item_id", "source").agg(F.min("rnk").alias("r")).withColumn("rn", F.row_number().over(Window.partitionBy("item_id").orderBy("r")))
    at = lambda k: F.round(F.avg(F.when(F.col("rn") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return gold.join(s, ["item_id", "source"], "left").groupBy("item_id").agg(at(3), at(5))


@query(f"with {CASES}, {'ov as (select * from (select item_id, doc_id, count(*) as score, row_number() over (partition by item_id order by count(*) desc, doc_id) as rnk from qt join tf using (term) group by item_id, doc_id) where rnk <= 10)'}, o as (select item_id, least(count(*) filter (where contains(d.text, b.text)), 1)::double as r from ov join documents d using (doc_id) join benchmark b using (item_id) group by item_id) select 'bm25' as config, round(avg(recall_10), 6) as recall_10, 0.0::double as delta from cs union all select 'overlap', round(avg(coalesce(r, 0)), 6), round(avg(coalesce(r, 0)) - avg(recall_10), 6) from cs left join o using (item_id)")
def ablation_deltas(t: Tables) -> DataFrame:
    """Two configurations on one set of cases, with signed deltas to the first."""
    a = evaluate.case_scores(judged(t), t.benchmark).select("item_id", F.col("recall_10").alias("x"))
    gold = t.benchmark.select("item_id", F.col("text").alias("gold"))
    h = with_text(t, overlap_channel(t, 10)).join(lexical.small(gold), "item_id").withColumn("hit", F.contains("text", "gold"))
    b = evaluate.case_scores(h, t.benchmark).select("item_id", F.col("recall_10").alias("y"))
    both = a.join(b, "item_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return both.select(F.expr("stack(2, 'bm25', round(x, 6), 0.0D, 'overlap', round(y, 6), round(y - x, 6)) as (config, recall_10, delta)"))


OBS = "ob as (select event_id as case_id, user_id as run_id, event_type, ts, value as latency, round(value / (value + 50), 6) as support, case event_type when 'error' then 'insufficient_evidence' else 'answered' end as outcome, json_extract_string(props, '$.k')::int as k from events)"


def observations(t: Tables) -> DataFrame:
    """Events as observations."""
    e = t.events
    outcome = F.when(F.col("event_type") == "error", "insufficient_evidence").otherwise("answered")
    return e.select(F.col("event_id").alias("case_id"), F.col("user_id").alias("run_id"), "event_type", "ts", F.col("value").alias("latency"), F.round(F.col("value") / (F.col("value") + 50), 6).alias("support"), outcome.alias("outcome"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(f"with {OBS} select run_id, count(*)::bigint as n, count(*) filter (where outcome = 'answered')::bigint as eligible_support, round(avg(support) filter (where outcome = 'answered'), 6) as support, round(avg(case when outcome = 'answered' then 1.0 else 0 end), 6) as answered_rate, round(avg(latency), 6) as latency_mean, round(quantile_cont(latency, 0.5), 6) as latency_p50, round(quantile_cont(latency, 0.95), 6) as latency_p95 from ob group by run_id")
def run_metrics(t: Tables) -> DataFrame:
    """Metrics per run, each over its own eligible rows; NULL where there are none."""
    ok = F.col("outcome") == "answered"
    return observations(t).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("eligible_support"), F.round(F.avg(F.when(ok, F.col("support"))), 6).alias("support"), F.round(F.avg(ok.cast("int")), 6).alias("answered_rate"), F.round(F.avg("latency"), 6).alias("latency_mean"), F.round(F.percentile("latency", F.lit(0.5)), 6).alias("latency_p50"), F.round(F.percentile("latency", F.lit(0.95)), 6).alias("latency_p95"))


@query(f"with {OBS} select tag, count(*)::bigint as n, round(avg(support), 6) as support, round(quantile_cont(latency, 0.95) filter (where latency > 0), 6) as p95 from (select *, unnest([event_type, 'k' || (k % 3)]) as tag from ob) group by tag")
def tag_slices(t: Tables) -> DataFrame:
    """Metrics per tag; a case counts in each of its tags."""
    o = observations(t).withColumn("tag", F.explode(F.array("event_type", F.concat(F.lit("k"), (F.col("k") % 3).cast("string")))))
    return o.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("support"), 6).alias("support"), F.round(F.percentile(F.when(F.col("latency") > 0, F.col("latency")), F.lit(0.95)), 6).alias("p95"))


#: Fields of a case beside its retrieval metrics, from the observation of its number.
CASE_FIELDS = ["outcome <> 'answered' as abstained", "recall_10 > 0 as must_answer", "recall_10 = 0 as expects_abstention", "support", "latency", "cast(k as double) / 100 as coverage", "case when k % 5 > 0 then (k % 5) / cast(4 as double) end as keyword_coverage", "case when k % 3 > 0 then k % 3 = 1 end as source_hit", "case when k % 4 = 0 then k >= 50 end as leaked", "k % 7 as steps", "k % 4 as tool_calls", "k % 2 as failed_calls", "k % 6 as repeated_calls", "k = 0 as failed", "k >= 90 as budget_stop", "k * 10 as tokens"]
REPORT = f"{CASES}, {OBS}, cr as (select item_id, recall_1, recall_3, recall_5, recall_10, mrr, ndcg, event_type, {', '.join(CASE_FIELDS)} from cs join ob on ob.case_id = cs.item_id)"


def case_report(t: Tables) -> DataFrame:
    """Passages as cases joined with their retrieval metrics and with the observation of their number."""
    c = evaluate.case_scores(judged(t), t.benchmark)
    return c.join(observations(t).withColumnRenamed("case_id", "item_id"), "item_id").selectExpr("item_id", "recall_1", "recall_3", "recall_5", "recall_10", "mrr", "ndcg", "event_type", *CASE_FIELDS)


def _metric_sql(name: str, n: str = "") -> str:
    if name in evaluate.PERCENTILES:
        value, count = f"quantile_cont(latency, {evaluate.PERCENTILES[name]}) filter (where latency > 0)", n or "count(*) filter (where latency > 0)"
    else:
        of, where = evaluate.METRICS[name]
        value, count = f"avg(({of})::double) filter (where {where})", f"count({of}) filter (where {where})"
    return f"'{name}' as metric, round({value}, 6) as value, {count}::bigint as n"


@query(f"with {REPORT} " + " union all ".join(f"select {_metric_sql(n)} from cr" for n in [*evaluate.METRICS, *evaluate.PERCENTILES]))
def run_report(t: Tables) -> DataFrame:
    """The 25 metrics of a run."""
    return evaluate.run_aggregate(case_report(t))


@query(f"with {REPORT}, tg as (select *, unnest([event_type, case when must_answer then 'gold' else 'no_gold' end]) as tag from cr) " + " union all ".join(f"select tag, {_metric_sql(n, 'count(latency)')} from tg group by tag" for n in [*evaluate.TAG_METRICS, "latency_p95_ms"]))
def tag_report(t: Tables) -> DataFrame:
    """Seven metrics per tag of the cases."""
    tags = F.array("event_type", F.when(F.col("must_answer"), "gold").otherwise("no_gold"))
    return evaluate.tag_aggregate(case_report(t).withColumn("tags", tags))


@query("select l.quality, l.toxic, count(*)::bigint as n, round(avg(d.n_chars), 6) as mean_chars, count(distinct d.source)::bigint as sources from documents d join labels l using (doc_id) group by all")
def label_slices(t: Tables) -> DataFrame:
    """Documents by label."""
    return t.documents.join(t.labels, "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.countDistinct("source").alias("sources"))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(max(value), 6) as worst from events group by event_type")
def percentile_latency(t: Tables) -> DataFrame:
    """Interpolated percentiles."""
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.max("value"), 6).alias("worst"))


def _boot(v: str) -> str:
    return f"""v as ({v}), n as (select count(*) as n from v), dr as (select r, ('0x' || substr(md5(r || ':' || i), 1, 8))::bigint % n as idx from n, generate_series(0, 999) a(r), generate_series(0, n - 1) b(i)),
me as (select r, round(avg(v), 9) as m from dr join v using (idx) group by r), rk as (select m, row_number() over (order by m) - 1 as k from me)
select (select round(avg(v), 6) from v) as mean, round(max(m) filter (where k = 25), 6) as low, round(max(m) filter (where k = 975), 6) as high from rk"""


def _indexed(per_user: DataFrame) -> DataFrame:
    """(idx, v) by user."""
    return evaluate.numbered(per_user, "user_id").select("idx", "v")


@query("with " + _boot("select row_number() over (order by user_id) - 1 as idx, round(avg(value), 6) as v from events group by user_id"))
def bootstrap_ci(t: Tables) -> DataFrame:
    """Mean per user with a percentile interval."""
    return evaluate.bootstrap(_indexed(t.events.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("v"))))


PAIRED = "select row_number() over (order by user_id) - 1 as idx, round(avg(value) filter (where event_type = 'click') - avg(value) filter (where event_type = 'view'), 6) as v from events group by user_id having count(*) filter (where event_type = 'click') > 0 and count(*) filter (where event_type = 'view') > 0"


@query("select mean, low, high, low <= 0 and high >= 0 as crosses_zero from (with " + _boot(PAIRED) + ")")
def paired_delta(t: Tables) -> DataFrame:
    """Paired difference of two event types per user, its interval, and whether that crosses zero."""
    a = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    d = t.events.groupBy("user_id").agg(F.round(a("click") - a("view"), 6).alias("v")).filter("v is not null")
    return evaluate.bootstrap(_indexed(d)).withColumn("crosses_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


@query("with u as (select user_id, avg(value) as v, row_number() over (order by user_id) as rn, count(*) over () as n from events group by user_id) select p::bigint as prefix, round(avg(v), 6) as mean from u, (values (50), (100), (200), (1000000)) x(p) where rn <= p and (p <= n or p = 1000000) group by p")
def prefix_curve(t: Tables) -> DataFrame:
    """Mean over the first 50, 100, 200 and all users, those prefixes that are there."""
    u = t.events.groupBy("user_id").agg(F.avg("value").alias("v"))
    u = evaluate.numbered(u, "user_id").withColumn("rn", F.col("idx") + 1).crossJoin(F.broadcast(u.agg(F.count(F.lit(1)).alias("n"))))
    u = u.withColumn("prefix", F.explode(F.array(*(F.lit(p).cast("long") for p in (50, 100, 200, 1_000_000)))))
    return u.filter("rn <= prefix and (prefix <= n or prefix = 1000000)").groupBy("prefix").agg(F.round(F.avg("v"), 6).alias("mean"))


@query()
def ann_overlap(t: Tables) -> DataFrame:
    """Share of the exact ten nearest of every fiftieth vector that the stored index finds, and the share of all vectors that it compares whole."""
    q = t.embeddings.filter("vec_id % 50 = 0")
    found = t.vector_index.search(q, 10).select("qid", F.col("id").alias("vec_id"), "compared")
    exact = dense.vector_top_k(q, t.embeddings, 10).select("qid", "vec_id")
    n = t.embeddings.agg(F.count(F.lit(1)).alias("n"))
    g = exact.join(found, ["qid", "vec_id"], "left").groupBy("qid").agg(F.round(F.count("compared") / F.count(F.lit(1)), 6).alias("overlap"), F.max("compared").alias("compared"))
    return g.crossJoin(F.broadcast(n)).select("qid", "overlap", F.round(F.coalesce("compared", F.lit(0)) / F.col("n"), 6).alias("compared_share"))


PAIR = f"pr as (select u.conv_id, u.turn, {TOK.replace('text', 'u.text')} as a, {TOK.replace('text', 'v.text')} as b from conversations u join conversations v on v.conv_id = u.conv_id and v.turn = u.turn + 1 where u.role = 'user' and v.role = 'assistant')"


@query(f"with {PAIR}, x as (select conv_id, turn, t, count(*) as n from (select conv_id, turn, unnest(a) as t from pr) group by all), y as (select conv_id, turn, t, count(*) as n from (select conv_id, turn, unnest(b) as t from pr) group by all), c as (select conv_id, turn, sum(least(x.n, y.n)) as c from x join y using (conv_id, turn, t) group by all) select conv_id, turn, round(case when coalesce(c, 0) = 0 then 0 else 2 * (c / len(b)) * (c / len(a)) / (c / len(b) + c / len(a)) end, 6) as f1 from pr left join c using (conv_id, turn)")
def token_f1(t: Tables) -> DataFrame:
    """Multiset token F1 of a user turn and the answer to it."""
    c = t.conversations
    u = c.filter("role = 'user'").select("conv_id", "turn", tx.tokens(F.col("text")).alias("a"))
    v = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), tx.tokens(F.col("text")).alias("b"))
    p = u.join(v, ["conv_id", "turn"])
    count = lambda x, n: p.select("conv_id", "turn", F.explode(x).alias("t")).groupBy("conv_id", "turn", "t").agg(F.count(F.lit(1)).alias(n))
    common = count("a", "x").join(count("b", "y"), ["conv_id", "turn", "t"]).groupBy("conv_id", "turn").agg(F.sum(F.least("x", "y")).alias("c"))
    j = p.join(common, ["conv_id", "turn"], "left")
    pr, rc = F.col("c") / F.size("b"), F.col("c") / F.size("a")
    return j.select("conv_id", "turn", F.round(F.when(F.coalesce("c", F.lit(0)) == 0, 0.0).otherwise(2 * pr * rc / (pr + rc)), 6).alias("f1"))


@query(f"with {OBS} select event_type as code, 's' || (k % 4) as stage, grouping(event_type, 's' || (k % 4))::int as level, count(*)::bigint as n, round(avg(case when latency < 50 then 1.0 else 0 end), 6) as recovered from ob group by grouping sets ((event_type), ('s' || (k % 4)), ())")
def failure_taxonomy(t: Tables) -> DataFrame:
    """Failures by code, by stage and in all, with the share recovered, in one pass."""
    o = observations(t).select(F.col("event_type").alias("code"), F.concat(F.lit("s"), (F.col("k") % 4).cast("string")).alias("stage"), F.when(F.col("latency") < 50, 1.0).otherwise(0.0).alias("ok"))
    g = o.groupingSets([[F.col("code")], [F.col("stage")], []], "code", "stage").agg(F.grouping_id("code", "stage").cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("ok"), 6).alias("recovered"))
    return g.select("code", "stage", "level", "n", "recovered")


@query(f"with {OBS}, m as (select run_id, map_from_entries(list(row(event_type, n))) as c from (select run_id, event_type, count(*) as n from ob group by all) group by run_id) select e.key as code, sum(e.value)::bigint as n from (select unnest(map_entries(c)) as e from m) group by e.key")
def taxonomy_rollup(t: Tables) -> DataFrame:
    """Count maps per run, summed over runs."""
    per = observations(t).groupBy("run_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("c"))
    return per.select(F.explode("c").alias("code", "v")).groupBy("code").agg(F.sum("v").alias("n"))


REASON = "case when event_type = 'purchase' and k > 90 then 'error' when event_type = 'signup' and k > 80 then 'user_negative' when k = 0 then 'empty_evidence' when k % 17 = 0 then 'regenerated' when support > 0 and support < 0.6 and event_type <> 'error' then 'low_support' when outcome in ('insufficient_evidence', 'no_knowledge', 'clarify') then 'abstained' end"


def mined(t: Tables) -> DataFrame:
    """Observations with the first failure reason that applies."""
    k, kind = F.col("k"), F.col("event_type")
    reason = (
        F.when((kind == "purchase") & (k > 90), "error")
        .when((kind == "signup") & (k > 80), "user_negative")
        .when(k == 0, "empty_evidence")
        .when(k % 17 == 0, "regenerated")
        .when((F.col("support") > 0) & (F.col("support") < 0.6) & (kind != "error"), "low_support")
        .when(F.col("outcome").isin(*tx.ABSTAIN_OUTCOMES), "abstained")
    )
    return observations(t).withColumn("reason", reason)


@query(f"with {OBS} select 'cand-' || substr(sha256(q), 1, 12) as candidate, min(case_id) as case_id, arg_min(reason, case_id) as reason from (select *, {REASON} as reason, 'question ' || run_id || ' ' || k as q from ob) where reason is not null and reason <> 'empty_evidence' group by q")
def mined_candidates(t: Tables) -> DataFrame:
    """Failures worth a review: classified, without empty evidence, the first of each question."""
    q = mined(t).withColumn("q", F.concat_ws(" ", F.lit("question"), F.col("run_id").cast("string"), F.col("k").cast("string"))).filter("reason is not null and reason <> 'empty_evidence'")
    g = q.groupBy("q").agg(F.min("case_id").alias("case_id"), F.min_by("reason", "case_id").alias("reason"))
    return g.select(F.concat(F.lit("cand-"), F.substr(F.sha2("q", 256), F.lit(1), F.lit(12))).alias("candidate"), "case_id", "reason")


@query(f"with {OBS} select coalesce({REASON}, 'none') as reason, count(*)::bigint as n from ob group by 1")
def miner_counts(t: Tables) -> DataFrame:
    """Observations by reason."""
    return mined(t).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {OBS}, d as (select date_trunc('day', ts) as day, count(*) filter (where event_type = 'purchase') as approved from ob group by 1) select strftime(day, '%Y-%m-%d') as day, approved::bigint as approved, sum(approved) over (order by day)::bigint as dataset_size, coalesce(sum(approved) over w = 0 and count(*) over w = 3, false) as stalled from d window w as (order by day rows between 2 preceding and current row)")
def flywheel_turns(t: Tables) -> DataFrame:
    """One turn a day: size of the dataset so far, and whether three turns in a row added nothing. A row per day, so the windows are small."""
    d = observations(t).groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count_if(F.col("event_type") == "purchase").alias("approved"))
    w = Window.orderBy("d")
    last = w.rowsBetween(-2, 0)
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "approved", F.sum("approved").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("dataset_size"), ((F.sum("approved").over(last) == 0) & (F.count(F.lit(1)).over(last) == 3)).alias("stalled"))


TUNE = "select count(*) as total, avg(case when outcome <> 'answered' then 1.0 else 0 end) as false_refusal, avg(case when support < 0.3 then 1.0 else 0 end) as hallucination, avg(case when k < 50 then 1.0 else 0 end) as recall5, avg(case when k = 0 then 1.0 else 0 end) as empty, avg(case when k % 10 = 0 then 1.0 else 0 end) as cache_hit from ob"


@query(f"""with {OBS}, m as ({TUNE}) select param, proposed, round(confidence, 6) as confidence, auto and total >= 200 and confidence >= 0.7 as auto from (
select total, 'sufficiency_min_coverage' as param, '0.4' as proposed, least(0.9, 0.5 + false_refusal) as confidence, true as auto, false_refusal * 100 >= 3 as fires from m
union all select total, 'sufficiency_min_coverage', '0.6', least(0.9, 0.5 + hallucination), true, hallucination * 100 >= 3 from m
union all select total, 'top_k', '12', 0.65, true, recall5 * 100 < 60 and empty < 0.2 from m
union all select total, 'coverage', 'extend the corpus', 0.8, false, empty >= 0.2 from m
union all select total, 'cache_key_normalization', 'normalised', 0.6, false, cache_hit > 0 and cache_hit < 0.15 from m) where fires""")
def tuner_rules(t: Tables) -> DataFrame:
    """Parameter suggestions from aggregate metrics; rules are rows, a missing metric fires none."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    m = observations(t).agg(F.count(F.lit(1)).alias("total"), share(F.col("outcome") != "answered").alias("refusal"), share(F.col("support") < 0.3).alias("hallucination"), share(F.col("k") < 50).alias("recall5"), share(F.col("k") == 0).alias("empty"), share(F.col("k") % 10 == 0).alias("cache_hit"))
    rules = """stack(5,
        'sufficiency_min_coverage', '0.4', least(0.9D, 0.5D + refusal), true, refusal * 100 >= 3,
        'sufficiency_min_coverage', '0.6', least(0.9D, 0.5D + hallucination), true, hallucination * 100 >= 3,
        'top_k', '12', 0.65D, true, recall5 * 100 < 60 and empty < 0.2,
        'coverage', 'extend the corpus', 0.8D, false, empty >= 0.2,
        'cache_key_normalization', 'normalised', 0.6D, false, cache_hit > 0 and cache_hit < 0.15) as (param, proposed, confidence, may, fires)"""
    return m.select("total", F.expr(rules)).filter("fires").select("param", "proposed", F.round("confidence", 6).alias("confidence"), F.expr("may and total >= 200 and confidence >= 0.7").alias("auto"))


@query("select event_type as model, count(*)::bigint as calls, round(sum(value), 6) as cost, grouping(event_type)::int as level from events group by rollup (event_type)")
def cost_ledger(t: Tables) -> DataFrame:
    """Cost per model and in all."""
    return t.events.rollup("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 6).alias("cost"), F.grouping("event_type").cast("int").alias("level")).withColumnRenamed("event_type", "model")


@query(f"with {OBS} select count(*)::bigint as total, count(distinct run_id || ':' || k)::bigint as questions, count(*) filter (where outcome <> 'answered')::bigint as abstained, count(*) filter (where support > 0 and support < 0.6)::bigint as low_support, count(*) filter (where k = 0)::bigint as empty from ob")
def observation_summary(t: Tables) -> DataFrame:
    """One row over all observations."""
    return observations(t).agg(F.count(F.lit(1)).alias("total"), F.countDistinct(F.concat_ws(":", F.col("run_id").cast("string"), F.col("k").cast("string"))).alias("questions"), F.count_if(F.col("outcome") != "answered").alias("abstained"), F.count_if((F.col("support") > 0) & (F.col("support") < 0.6)).alias("low_support"), F.count_if(F.col("k") == 0).alias("empty"))


@query("select user_id as run_id, event_type as kind, round(sum(value), 6) as total_ms, count(*) filter (where event_type = 'error')::bigint as failed from events group by all")
def step_time(t: Tables) -> DataFrame:
    """Time per run and kind of step, with failed steps."""
    return t.events.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("kind")).agg(F.round(F.sum("value"), 6).alias("total_ms"), F.count_if(F.col("event_type") == "error").alias("failed"))


JUDGE = f"{OBS}, jd as (select *, round(5 * support, 6) as judge, round(5 * (k / 100.0), 6) as human from ob)"


@query(f"with {JUDGE} select event_type, count(*)::bigint as n, round(avg(judge - human), 6) as bias, round(avg(case when abs(judge - human) <= 1 then 1.0 else 0 end), 6) as agreement, count(*) >= 10 and avg(case when abs(judge - human) <= 1 then 1.0 else 0 end) >= 0.7 as trusted from jd group by event_type")
def judge_calibration(t: Tables) -> DataFrame:
    """Bias and agreement of a judge with human scores."""
    j = observations(t).select("event_type", F.round(5 * F.col("support"), 6).alias("judge"), F.round(5 * F.col("k") / 100, 6).alias("human"))
    agree = F.avg((F.abs(F.col("judge") - F.col("human")) <= 1).cast("int"))
    return j.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("judge") - F.col("human")), 6).alias("bias"), F.round(agree, 6).alias("agreement"), ((F.count(F.lit(1)) >= 10) & (agree >= 0.7)).alias("trusted"))


@query(f"with {OBS} select case_id, round(0.5 * least(latency, 100) / 100 + 0.35 * k / 100.0 + 0.15 * (case when outcome = 'answered' then 1 else 0 end), 6) as rubric, case when k % 2 = 0 and event_type = 'click' then 'tie' when support >= 0.5 then 'a' else 'b' end as winner from ob")
def rubric_scores(t: Tables) -> DataFrame:
    """Weighted rubric; pairwise verdicts that change with the order are ties."""
    o = observations(t)
    s = 0.5 * F.least("latency", F.lit(100.0)) / 100 + 0.35 * F.col("k") / 100 + 0.15 * (F.col("outcome") == "answered").cast("int")
    first = F.when(F.col("support") >= 0.5, "a").otherwise("b")
    swapped = F.when((F.col("k") % 2 == 0) & (F.col("event_type") == "click"), F.when(first == "a", "b").otherwise("a")).otherwise(first)
    return o.select("case_id", F.round(s, 6).alias("rubric"), F.when(first == swapped, first).otherwise("tie").alias("winner"))


@query("select u.conv_id, u.turn, md5(u.text) as prompt, md5(a.text) as chosen, md5(b.text) as rejected from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' join conversations b on b.conv_id = u.conv_id and b.turn = u.turn + 3 and b.role = 'assistant' where u.role = 'user' and a.text <> '' and b.text <> '' and a.text <> b.text")
def preference_pairs(t: Tables) -> DataFrame:
    """Prompt, chosen and rejected answers; empty and equal pairs dropped."""
    c = t.conversations
    ans = lambda d, n: c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - d).alias("turn"), F.col("text").alias(n))
    j = c.filter("role = 'user'").join(ans(1, "chosen"), ["conv_id", "turn"]).join(ans(3, "rejected"), ["conv_id", "turn"]).filter("chosen <> '' and rejected <> '' and chosen <> rejected")
    return j.select("conv_id", "turn", F.md5("text").alias("prompt"), F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


@query(f"with {OBS}, ca as (select run_id, k, min(case_id) as case_id from ob where event_type = 'error' group by all), de as (select user_id as run_id, json_extract_string(props, '$.k')::int as k, max(case when event_type = 'purchase' then 'approve' else 'reject' end) as decision from events where event_type in ('purchase', 'signup') group by all) select case_id, coalesce(case decision when 'approve' then 'approved' when 'reject' then 'rejected' end, 'pending') as status from ca left join de using (run_id, k)")
def review_queue(t: Tables) -> DataFrame:
    """Candidates with the decision taken on them, if any."""
    o = observations(t)
    c = o.filter("event_type = 'error'").groupBy("run_id", "k").agg(F.min("case_id").alias("case_id"))
    d = o.filter("event_type in ('purchase', 'signup')").groupBy("run_id", "k").agg(F.max(F.when(F.col("event_type") == "purchase", "approve").otherwise("reject")).alias("decision"))
    # max: 'reject' sorts after 'approve', so one rejection decides
    return c.join(d, ["run_id", "k"], "left").select("case_id", F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").otherwise("pending").alias("status"))


@query(f"with {OBS} select min(case_id) as case_id, run_id, k from ob o where event_type = 'error' and not exists (select 1 from ob p where p.event_type = 'purchase' and p.run_id = o.run_id and p.k = o.k) group by run_id, k")
def dataset_increment(t: Tables) -> DataFrame:
    """New questions that the dataset doesn't have."""
    o = observations(t)
    return o.filter("event_type = 'error'").join(o.filter("event_type = 'purchase'").select("run_id", "k").distinct(), ["run_id", "k"], "left_anti").groupBy("run_id", "k").agg(F.min("case_id").alias("case_id"))


@query(f"with {OBS} select run_id, k, min(case_id) filter (where event_type = 'purchase') as dataset_case, case when count(*) filter (where event_type = 'purchase') > 0 then min(case_id) filter (where event_type = 'purchase') else min(case_id) end as case_id from ob where event_type in ('purchase', 'error') group by run_id, k")
def dataset_union(t: Tables) -> DataFrame:
    """The dataset with its increment: cases of a question that is there already stay, new questions are appended. One aggregate in place of the anti join and the union."""
    old = F.min(F.when(F.col("event_type") == "purchase", F.col("case_id")))
    return observations(t).filter("event_type in ('purchase', 'error')").groupBy("run_id", "k").agg(old.alias("dataset_case"), F.coalesce(old, F.min("case_id")).alias("case_id"))


@query(f"with {OBS} select case_id, array_to_string(list_filter([case when k >= 40 then 'multi_hop' end, case when outcome <> 'answered' then 'no_knowledge' end], lambda x: x is not null), ',') as tags from ob")
def tag_guess(t: Tables) -> DataFrame:
    """Guessed tags of new cases."""
    tags = F.array_compact(F.array(F.when(F.col("k") >= 40, "multi_hop"), F.when(F.col("outcome") != "answered", "no_knowledge")))
    return observations(t).select("case_id", F.array_join(tags, ",").alias("tags"))


RULES = [("action", "delete"), ("action", "refund"), ("smalltalk", "the"), ("smalltalk", "wetter"), ("knowledge", "ertion"), ("knowledge", "ation"), ("knowledge", "keit")]
RULE_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in RULES)


@query(f"with r(label, pattern) as (values {RULE_ROWS}), h as (select conv_id, turn, label, max(length(pattern)) as longest from conversations, r where role = 'user' and contains(lower(text), pattern) group by all), s as (select *, least(0.95, 0.70 + 0.05 * longest) as conf from h), o as (select *, row_number() over (partition by conv_id, turn order by conf desc, longest desc, label) as rn, lead(conf) over (partition by conv_id, turn order by conf desc, longest desc, label) as second from s) select conv_id, turn, label, round(conf, 6)::double as confidence, round(conf - coalesce(second, 0), 6)::double as margin from o where rn = 1 and (second is null or conf > second)")
def intent_rules(t: Tables) -> DataFrame:
    """Intents by rule: the longest hit decides; equal ones decide nothing."""
    r = t.spark.createDataFrame(RULES, "label string, pattern string")
    u = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.lower("text").alias("s"))
    h = u.join(F.broadcast(r), F.contains("s", "pattern")).groupBy("conv_id", "turn", "label").agg(F.max(F.length("pattern")).alias("longest"))
    s = h.withColumn("conf", F.least(F.lit(0.95), 0.70 + 0.05 * F.col("longest")))
    w = Window.partitionBy("conv_id", "turn").orderBy(F.desc("conf"), F.desc("longest"), "label")
    o = s.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("conf").over(w)).filter("rn = 1 and (second is null or conf > second)")
    return o.select("conv_id", "turn", "label", F.round("conf", 6).alias("confidence"), F.round(F.col("conf") - F.coalesce("second", F.lit(0.0)), 6).alias("margin"))


@query("with c as (select q.vec_id as qid, v.label, max(list_cosine_similarity(q.embedding::double[], v.embedding::double[])) as s from embeddings q, embeddings v where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id group by all), o as (select *, row_number() over (partition by qid order by s desc, label) as rn, lead(s) over (partition by qid order by s desc, label) as second from c) select qid, label, case when round(s, 6) < 0.62 then 'unknown' when round(s - second, 6) < 0.15 then 'clarify' when label = 0 then 'clarify' else 'semantic' end as tier from o where rn = 1")
def intent_semantic(t: Tables) -> DataFrame:
    """Intents by vectors: high score and a margin, otherwise no decision."""
    c = dense.label_best(t.embeddings.filter("vec_id % 50 = 0"), t.embeddings).select("qid", "label", F.col("score").alias("s"))
    w = Window.partitionBy("qid").orderBy(F.desc("s"), "label")
    o = c.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("s").over(w)).filter("rn = 1")
    tier = F.when(F.round("s", 6) < 0.62, "unknown").when(F.round(F.col("s") - F.col("second"), 6) < 0.15, "clarify").when(F.col("label") == 0, "clarify").otherwise("semantic")
    return o.select("qid", "label", tier.alias("tier"))


@query("select conv_id, turn, case when role = 'system' then 'light' when role = 'user' and length(text) <= 6000 then 'light' when role = 'assistant' then 'strong' when length(text) > 6000 then 'strong' else 'strong' end as model from conversations")
def model_routing(t: Tables) -> DataFrame:
    """Model per turn: overrides, short light tasks, the strong one otherwise."""
    m = F.when(F.col("role") == "system", "light").when((F.col("role") == "user") & (F.length("text") <= 6000), "light").otherwise("strong")
    return t.conversations.select("conv_id", "turn", m.alias("model"))


# Recovery actions by failure code, in order.
POLICY = {
    "click": ("retry", "fallback", "stop"),
    "view": ("reprompt", "retry", "stop"),
    "signup": ("reprompt", "stop"),
    "purchase": ("stop",),
    "error": ("rewrite", "clarify", "abstain"),
}
POLICY_ROWS = ", ".join(f"('{c}', '{a}', {i})" for c, acts in POLICY.items() for i, a in enumerate(acts))


@query(f"with {OBS}, p(code, action, i) as (values {POLICY_ROWS}), f as (select *, row_number() over (partition by run_id, event_type order by ts, case_id) as attempt from ob), x as (select case_id, attempt, action, row_number() over (partition by case_id order by i) as rn from f join p on code = event_type where not (action = 'retry' and k % 2 = 1) and (attempt <= 3 or action in ('stop', 'abstain'))) select case_id, attempt::bigint as attempt, action from x where rn = 1")
def recovery_actions(t: Tables) -> DataFrame:
    """The first action of the policy that still applies: retries need a retryable failure, and after three attempts only the last resort is left."""
    p = t.spark.createDataFrame([(c, a, i) for c, acts in POLICY.items() for i, a in enumerate(acts)], "event_type string, action string, i int")
    o = observations(t).withColumn("attempt", F.row_number().over(Window.partitionBy("run_id", "event_type").orderBy("ts", "case_id")).cast("long"))
    x = o.join(F.broadcast(p), "event_type").filter(~((F.col("action") == "retry") & (F.col("k") % 2 == 1)) & ((F.col("attempt") <= 3) | F.col("action").isin("stop", "abstain")))
    return x.groupBy("case_id", "attempt").agg(F.min_by("action", "i").alias("action"))


@query("select event_id, case when value > 100 then case event_type when 'purchase' then 'abort' when 'view' then 'auto_approve' else 'reject' end else 'waiting' end as decision from events")
def approval_timeouts(t: Tables) -> DataFrame:
    """What an approval turns into past its deadline."""
    d = F.when(F.col("value") > 100, F.when(F.col("event_type") == "purchase", "abort").when(F.col("event_type") == "view", "auto_approve").otherwise("reject")).otherwise("waiting")
    return t.events.select("event_id", d.alias("decision"))


@query("select user_id as run_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc)::int as undo_order from events where event_type = 'purchase'")
def compensation_plan(t: Tables) -> DataFrame:
    """Executed effects in reverse."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("run_id"), "event_id", F.row_number().over(w).alias("undo_order"))


@query(rf"select doc_id, array_to_string(list_filter([case when length(text) < 20 then 'short' end, case when n_chars <> length(text) then 'length' end, case when lang not in ('en', 'de', 'fr', 'es') then 'lang' end, case when len({TOK}) = 0 then 'no_tokens' end], lambda x: x is not null), ',') as problems from documents")
def dataset_validation(t: Tables) -> DataFrame:
    """Problems of each row by rule."""
    rules = F.array(F.when(F.length("text") < 20, "short"), F.when(F.col("n_chars") != F.length("text"), "length"), F.when(~F.col("lang").isin("en", "de", "fr", "es"), "lang"), F.when(F.size(tx.tokens(F.col("text"))) == 0, "no_tokens"))
    return t.documents.select("doc_id", F.array_join(F.array_compact(rules), ",").alias("problems"))
