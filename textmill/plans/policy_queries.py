"""Queries of rewriting, gates on answers, ablation, judging, tool state and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.config import DEFAULT
from textmill.functions import text as tx
from textmill.functions.tools import schema_problems
from textmill.operators import extract, lexical, split
from textmill.plans.evaluation_queries import OBS, observations
from textmill.plans.registry import Tables, query
from textmill.plans.retrieval_queries import CLAIMS, FOCUS, INDEX, QW, RERANK, SENT, SSCORE, STOK, UNKNOWN, TOK, _hits_sql, evidence, extractive_answer, fused, grade_route, hits, overlap_channel, reranked, scored_sentences, verdicts, weighed_terms, with_text


@query(f"""with {INDEX}, {UNKNOWN}, nb as (select uk.term, min(df.term) as fix from uk join df on length(uk.term) >= 2 and length(df.term) >= 2 and abs(length(uk.term) - length(df.term)) <= 1 and levenshtein(uk.term, df.term) <= 1 group by uk.term),
u as (select conv_id, turn, unnest(list_distinct({TOK})) as term from conversations where role = 'user'), tot as (select greatest(sum(df), 1) as total from df),
g as (select conv_id, turn, count(*) as n, count(*) filter (where df is null) as oov, count(*) filter (where df between 1 and 2) as rare, count(*) filter (where coalesce(df, 0) / total >= 0.3) as generic, string_agg(u.term || '>' || fix, '|' order by u.term) filter (where fix is not null) as fixes from u left join df using (term) left join nb using (term), tot group by conv_id, turn)
select conv_id, turn, case when fixes is not null then 'term_fix' when oov / n >= 0.4 then 'hyde' when rare >= 3 or (rare >= 2 and n <= 8) then 'step_back' when n <= 3 and generic = n then 'specify' else 'none' end as method, coalesce(fixes, '') as fixes from g""")
def rewrite_plans(t: Tables) -> DataFrame:
    """How each user turn is rewritten: misspelt words first, then unknown, too narrow and too broad ones; with the words' replacements."""
    df = t.index.frequency()
    u = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    unknown = u.select("term").distinct().join(df, "term", "left_anti")
    fixes = lexical.neighbours(unknown, df.select("term")).groupBy("term").agg(F.min("neighbour").alias("fix"))
    total = df.agg(F.greatest(F.sum("df"), F.lit(1)).alias("total"))
    j = u.join(df, "term", "left").join(fixes, "term", "left").crossJoin(F.broadcast(total))
    g = j.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("df").isNull()).alias("oov"), F.count_if(F.col("df").between(1, 2)).alias("rare"), F.count_if(F.coalesce("df", F.lit(0)) / F.col("total") >= 0.3).alias("generic"), F.array_sort(F.collect_list(F.when(F.col("fix").isNotNull(), F.struct("term", "fix")))).alias("f"))
    narrow = (F.col("rare") >= 3) | ((F.col("rare") >= 2) & (F.col("n") <= 8))
    method = F.when(F.size("f") > 0, "term_fix").when(F.col("oov") / F.col("n") >= 0.4, "hyde").when(narrow, "step_back").when((F.col("n") <= 3) & (F.col("generic") == F.col("n")), "specify").otherwise("none")
    return g.select("conv_id", "turn", method.alias("method"), F.array_join(F.transform("f", lambda x: F.concat(x.term, F.lit(">"), x.fix)), "|").alias("fixes"))


@query(f"""with {_hits_sql(8)}, {CLAIMS}, g as (select c.item_id, c.i, c.s, case when c.cite is null then length(c.s) <= 12 when h.doc_id is null then false when len(c.toks) = 0 then true else len(list_filter(c.toks, lambda x: list_contains(tk.t, x))) / len(c.toks) >= 0.3 end as kept
from cs c left join hits h on h.item_id = c.item_id and h.rnk = c.cite left join tk using (doc_id))
select item_id, coalesce(md5(string_agg(s, '' order by i) filter (where kept)), '') as digest, count(*) filter (where not kept)::bigint as removed from g group by item_id""")
def attribution_gate(t: Tables) -> DataFrame:
    """Answers (passages; odd sentences cite the evidence of their number) without the sentences that their evidence doesn't support."""
    c = t.benchmark.select("item_id", F.posexplode(tx.sentences(F.col("text"), "。！？!?；;.\n")).alias("p", "s"))
    c = c.select("item_id", (F.col("p") + 1).alias("n"), "s", F.array_distinct(tx.tokens(F.col("s"))).alias("toks"))
    e = evidence(t, 8).select("item_id", F.col("rnk").alias("n"), tx.tokens(F.col("text")).alias("t"))
    share = F.size(F.array_intersect("toks", "t")) / F.size("toks")
    kept = F.when(F.col("n") % 2 == 0, F.length("s") <= DEFAULT.free_chars).when(F.col("t").isNull(), False).when(F.size("toks") == 0, True).otherwise(share >= DEFAULT.cited_support)
    g = c.join(e, ["item_id", "n"], "left").withColumn("kept", kept).groupBy("item_id").agg(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("n", "s")))).alias("k"), F.count_if(~F.col("kept")).alias("removed"))
    return g.select("item_id", F.when(F.size("k") > 0, F.md5(F.array_join(F.transform("k", lambda x: x.s), ""))).otherwise("").alias("digest"), "removed")


@query(f"with {_hits_sql(8)}, {QW}, x as (select item_id, unnest(list_filter(q, lambda x: length(x) > 1)) as term from qw), sn as (select distinct item_id, term from hits join tf using (doc_id)) select x.item_id, round(avg(case when sn.term is null then 0.0 else 1.0 end), 6) as footprint from x left join sn using (item_id, term) group by x.item_id")
def evidence_footprint(t: Tables) -> DataFrame:
    """Share of the query's terms that the evidence found so far holds."""
    q = t.benchmark.select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).filter("length(term) > 1")
    seen = evidence(t, 8).select("item_id", F.explode(F.array_intersect("q", tx.tokens(F.col("text")))).alias("term")).distinct().withColumn("seen", F.lit(1))
    return q.join(seen, ["item_id", "term"], "left").groupBy("item_id").agg(F.round(F.avg(F.coalesce("seen", F.lit(0))), 6).alias("footprint"))


ANSWER = f"""with {FOCUS}, s as (select item_id, doc_id, rnk, q, unnest({SENT}) as s, generate_subscripts({SENT}, 1) as i from hits join documents using (doc_id) join qw using (item_id) where rnk <= 3),
r as (select *, row_number() over (partition by item_id, doc_id order by len(list_filter(q, lambda x: list_contains({STOK}, x))) desc, i) as rn from s),
ex as (select item_id, md5(string_agg(s || '[' || rnk || ']', '' order by rnk)) as digest from r where rn = 1 group by item_id),
vd as (select item_id, case when relevance >= 0.5 then 'answer' when coverage < 0.12 then 'clarify' else 'rewrite' end as route, case when not exists (select 1 from hits where hits.item_id = cv.item_id) then 'abstain' when not (coverage >= 0.5 and coalesce(focus, 0) >= 0.5) then 'abstain' when relevance < 0.5 then 'regenerate' else 'pass' end as verdict from cv left join fc using (item_id))"""


@query(f"{ANSWER} select item_id, route, verdict, case when verdict <> 'abstain' then 'answered' when digest is null then 'no_knowledge' when route = 'clarify' then 'clarify' else 'insufficient_evidence' end as outcome, case when verdict <> 'abstain' then digest else '' end as answer from vd left join ex using (item_id)")
def answers(t: Tables) -> DataFrame:
    """The whole chain for a batch of questions: search, grade, gates, and an extractive answer or the reason for none.

    Evidence (eight texts a question) and term weights are made once and checkpointed: the gates all read them.
    """
    t.pin("evidence", evidence(t, 8))
    t.pin("weights", weighed_terms(t))
    v = grade_route(t).select("item_id", "route").join(verdicts(t), "item_id").join(extractive_answer(t).select("item_id", "digest"), "item_id", "left")
    ok = F.col("verdict") != "abstain"
    outcome = F.when(ok, "answered").when(F.col("digest").isNull(), "no_knowledge").when(F.col("route") == "clarify", "clarify").otherwise("insufficient_evidence")
    return v.select("item_id", "route", "verdict", outcome.alias("outcome"), F.when(ok, F.col("digest")).otherwise("").alias("answer"))


@query(f"""{RERANK}, ls as (select 'full' as config, item_id, doc_id, pos as rnk from re where pos <= 10 union all select 'no_rerank', item_id, doc_id, rnk from rf where rnk <= 10 union all select 'sparse_only', item_id, doc_id, rnk from hits where rnk <= 10 union all select 'overlap_only', item_id, doc_id, rnk from ov where rnk <= 10),
jd as (select ls.config, ls.item_id, ls.rnk, contains(d.text, b.text) as hit from ls join documents d using (doc_id) join benchmark b using (item_id)),
pc as (select config, item_id, least(count(*) filter (where hit and rnk <= 5), 1) as r5, coalesce(1.0 / min(rnk) filter (where hit), 0)::double as mrr from jd group by all),
mc as (select config, sum(r5) / (select count(*) from benchmark) as r5, sum(mrr) / (select count(*) from benchmark) as mrr from pc group by config)
select config, round(r5, 6) as recall_5, round(mrr, 6) as mrr, round(r5 - (select r5 from mc where config = 'full'), 6) as delta from mc""")
def ablation_matrix(t: Tables) -> DataFrame:
    """Configurations of the search on one index: recall, MRR, and the change of recall against the full one."""
    lists = {"full": reranked(t).select("item_id", "doc_id", F.col("pos").alias("rnk")), "no_rerank": fused(t).select("item_id", "doc_id", "rnk"), "sparse_only": hits(t, 10).select("item_id", "doc_id", "rnk"), "overlap_only": overlap_channel(t, 10).select("item_id", "doc_id", "rnk")}
    ranked = None
    for name, rows in lists.items():
        rows = rows.filter("rnk <= 10").withColumn("config", F.lit(name))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    gold = t.benchmark.select("item_id", F.col("text").alias("gold"))
    j = with_text(t, ranked).join(lexical.small(gold), "item_id").withColumn("hit", F.contains("text", "gold"))
    c = j.groupBy("config", "item_id").agg(F.max((F.col("hit") & (F.col("rnk") <= 5)).cast("int")).alias("r5"), F.coalesce(1 / F.min(F.when(F.col("hit"), F.col("rnk"))), F.lit(0.0)).alias("mrr"))
    n = t.benchmark.agg(F.count(F.lit(1)).alias("cases"))
    m = c.groupBy("config").agg(F.sum("r5").alias("r5"), F.sum("mrr").alias("mrr")).crossJoin(F.broadcast(n)).select("config", (F.col("r5") / F.col("cases")).alias("r5"), (F.col("mrr") / F.col("cases")).alias("mrr"))
    full = F.max(F.when(F.col("config") == "full", F.col("r5"))).over(Window.partitionBy())  # a row per configuration
    return m.select("config", F.round("r5", 6).alias("recall_5"), F.round("mrr", 6).alias("mrr"), F.round(F.col("r5") - full, 6).alias("delta"))


@query(f"""with {_hits_sql(3)}, {QW}, s as (select item_id, doc_id, length(text) as n, q, unnest({SENT}) as s, generate_subscripts({SENT}, 1) as i from hits join documents using (doc_id) join qw using (item_id)),
r as (select *, row_number() over (partition by item_id, doc_id order by {SSCORE} desc, i) as rn from s),
u as (select item_id, doc_id, any_value(n) as n, count(*) as total, least(any_value(n), sum(length(s)) filter (where rn <= 3) + count(*) filter (where rn <= 3) - 1) as after, sum(length(s)) filter (where rn <= 3) + count(*) filter (where rn <= 3) - 1 < any_value(n) as shorter from r group by item_id, doc_id)
select item_id, count(*)::bigint as units, sum(n)::bigint as chars_before, sum(after)::bigint as chars_after, round(1 - sum(after) / sum(n), 6) as savings, sum(case when shorter then least(total, 3) else total end)::bigint as sentences_kept, sum(total)::bigint as sentences_total from u group by item_id""")
def compression_account(t: Tables) -> DataFrame:
    """What compressing the evidence to its three best sentences a unit saves."""
    w = Window.partitionBy("item_id", "doc_id").orderBy(F.desc("score"), "i")
    r = scored_sentences(t, 3).withColumn("rn", F.row_number().over(w))
    best = F.col("rn") <= 3
    size = F.sum(F.when(best, F.length("s"))) + F.count_if(best) - 1
    u = r.groupBy("item_id", "doc_id").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("total"), size.alias("size"))
    kept = F.when(F.col("size") < F.col("n"), F.least(F.col("total"), F.lit(3))).otherwise(F.col("total"))
    g = u.groupBy("item_id").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("chars_before"), F.sum(F.least("n", "size")).alias("chars_after"), F.sum(kept).alias("sentences_kept"), F.sum("total").alias("sentences_total"))
    return g.withColumn("savings", F.round(1 - F.col("chars_after") / F.col("chars_before"), 6)).select("item_id", "units", F.col("chars_before").cast("long").alias("chars_before"), F.col("chars_after").cast("long").alias("chars_after"), "savings", F.col("sentences_kept").cast("long").alias("sentences_kept"), "sentences_total")


@query(f"with {_hits_sql(1)}, f as (select item_id, unnest(list_distinct({TOK})) as fact from benchmark), c as (select f.item_id, f.fact, coalesce(contains(lower(d.text), f.fact), false) as found from f left join hits using (item_id) left join documents d using (doc_id)) select item_id, round(avg(case when found then 1.0 else 0.0 end), 6) as hit_rate, coalesce(string_agg(fact, '|' order by fact) filter (where not found), '') as misses from c group by item_id")
def fact_hit_rate(t: Tables) -> DataFrame:
    """Share of a passage's words that the text of its best hit contains in any case, and those it lacks."""
    f = t.benchmark.select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("fact"))
    best = evidence(t, 1).select("item_id", F.lower("text").alias("text"))
    c = f.join(best, "item_id", "left").withColumn("found", F.coalesce(F.contains("text", "fact"), F.lit(False)))
    return c.groupBy("item_id").agg(F.round(F.avg(F.col("found").cast("int")), 6).alias("hit_rate"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("fact")))), "|").alias("misses"))


@query(f"with {_hits_sql(8)} select b.item_id, coalesce(string_agg(h.doc_id::varchar, '|' order by rnk), '') as retrieved_chunk_ids, coalesce(string_agg(d.source, '|' order by rnk), '') as retrieved_sources, count(h.doc_id)::bigint as n, count(h.doc_id) = 0 as abstained from benchmark b left join hits h using (item_id) left join documents d on d.doc_id = h.doc_id group by b.item_id")
def observation_records(t: Tables) -> DataFrame:
    """A run's result per question as an observation: what was retrieved, in order, and whether that was nothing."""
    h = evidence(t, 8).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "doc_id", "source"))).alias("u"))  # eight units at most
    j = t.benchmark.select("item_id").join(h, "item_id", "left").withColumn("u", F.coalesce("u", F.array().cast("array<struct<rnk:int,doc_id:bigint,source:string>>")))
    flat = lambda f: F.array_join(F.transform("u", f), "|")
    return j.select("item_id", flat(lambda x: x.doc_id.cast("string")).alias("retrieved_chunk_ids"), flat(lambda x: x.source).alias("retrieved_sources"), F.size("u").cast("long").alias("n"), (F.size("u") == 0).alias("abstained"))


# Tools that runs call, which are the types of their events: whether one has side effects, and what compensates it.
TOOLS = [("view", False, ""), ("click", False, ""), ("signup", True, "cancel_signup"), ("purchase", True, "refund"), ("error", True, "")]


@query("select name, case when not side_effects then 'safe' when compensator <> '' then 'confirm' else 'required' end as level, not side_effects as auto_approve, count(event_id)::bigint as calls, count(distinct user_id)::bigint as runs from (values " + ", ".join(f"('{n}', {str(s).lower()}, '{c}')" for n, s, c in TOOLS) + ") v(name, side_effects, compensator) join events on event_type = name group by all")
def tool_risk(t: Tables) -> DataFrame:
    """Risk of the tools that runs have called: read-only ones are safe, those that can be compensated need a confirmation, others an approval."""
    tools = t.spark.createDataFrame(TOOLS, "name string, side_effects boolean, compensator string")
    level = F.when(~F.col("side_effects"), "safe").when(F.col("compensator") != "", "confirm").otherwise("required")
    calls = t.events.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("runs"))
    return tools.join(calls, "name").select("name", level.alias("level"), (~F.col("side_effects")).alias("auto_approve"), "calls", "runs")


VOTE = "case {} % 3 when 0 then 'A' when 1 then 'B' else 'tie' end"


@query(f"with {OBS}, p as (select case_id, {VOTE.format('k')} as first, {VOTE.format('case_id')} as swapped from ob), m as (select case_id, first, case swapped when 'A' then 'B' when 'B' then 'A' else 'tie' end as second from p) select case_id, case when first = second then first else 'tie' end as winner, first <> second as inconsistent from m")
def pairwise_judgement(t: Tables) -> DataFrame:
    """Winner of two answers judged in both orders: the second vote is mapped back, and votes that differ are a tie."""
    vote = lambda c: F.when(F.col(c) % 3 == 0, "A").when(F.col(c) % 3 == 1, "B").otherwise("tie")
    m = observations(t).select("case_id", vote("k").alias("first"), vote("case_id").alias("swapped"))
    second = F.when(F.col("swapped") == "A", "B").when(F.col("swapped") == "B", "A").otherwise("tie")
    return m.select("case_id", F.when(F.col("first") == second, F.col("first")).otherwise("tie").alias("winner"), (F.col("first") != second).alias("inconsistent"))


@query(f"with {OBS} select event_type, count(*)::bigint as n, round(avg(case when (support >= 0.6) = (k / 100 >= 0.6) then 1.0 else 0.0 end), 6) as agreement, count(*) filter (where (support >= 0.6) <> (k / 100 >= 0.6))::bigint as disagreements from ob group by event_type")
def judge_agreement(t: Tables) -> DataFrame:
    """How often the lexical verdict and the judge's score over its threshold agree."""
    agree = (F.col("support") >= DEFAULT.support_floor) == (F.col("k") / 100 >= 0.6)
    return observations(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(agree.cast("int")), 6).alias("agreement"), F.count_if(~agree).alias("disagreements"))


@query(f"with {OBS} select case_id, support, round(k / 100, 6) as judged, support >= 0.6 as lexical_ok from ob where (support >= 0.6) <> (k / 100 >= 0.6)")
def judge_disagreements(t: Tables) -> DataFrame:
    """The cases on which the lexical verdict and the judge's score differ."""
    lexical_ok, judged = F.col("support") >= DEFAULT.support_floor, F.col("k") / 100
    return observations(t).filter(lexical_ok != (judged >= 0.6)).select("case_id", "support", F.round(judged, 6).alias("judged"), lexical_ok.alias("lexical_ok"))


@query(f"with {OBS} select count(distinct event_type)::bigint as scenarios, round(avg(case when outcome = 'answered' or k > 0 then 1.0 else 0.0 end), 6) as typed_failure, round(avg(case when support >= 0.3 then 1.0 else 0.0 end), 6) as recovered, count(*) filter (where k = 99)::bigint as crashes from ob")
def fault_summary(t: Tables) -> DataFrame:
    """Rates of typed failures and recoveries over injected faults, and crashes."""
    typed = (F.col("outcome") == "answered") | (F.col("k") > 0)
    return observations(t).agg(F.countDistinct("event_type").alias("scenarios"), F.round(F.avg(typed.cast("int")), 6).alias("typed_failure"), F.round(F.avg((F.col("support") >= 0.3).cast("int")), 6).alias("recovered"), F.count_if(F.col("k") == 99).alias("crashes"))


#: Searches that one run may make.
SEARCHES = 4


@query(f"with {OBS}, fs as (select run_id, event_type, min(case_id) as first, row_number() over (partition by run_id order by min(case_id)) as nth from ob group by run_id, event_type) select ob.case_id, case when nth > {SEARCHES} then 'budget_exceeded' when case_id > first then 'repeated' else 'ok' end as status from ob join fs using (run_id, event_type)")
def search_tool_state(t: Tables) -> DataFrame:
    """Search calls of a run: repeated queries and those beyond the limit are refused; a refused query isn't remembered.

    The window runs over a run's different queries, not its calls.
    """
    o = observations(t).select("case_id", "run_id", "event_type")
    first = o.groupBy("run_id", "event_type").agg(F.min("case_id").alias("first"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("run_id").orderBy("first")))
    return o.join(first, ["run_id", "event_type"]).select("case_id", F.when(F.col("nth") > SEARCHES, "budget_exceeded").when(F.col("case_id") > F.col("first"), "repeated").otherwise("ok").alias("status"))


# Tasks whose results are cached.
CACHED_TASKS = ("grade", "rewrite", "intent", "subquestions", "decide")
TASK = "case event_type when 'click' then 'grade' when 'purchase' then 'rewrite' when 'signup' then 'intent' when 'error' then 'decide' else 'answer' end"


@query(f"with {OBS}, c as (select case_id, {TASK} as task, k, floor(latency)::bigint as tokens from ob), f as (select task, k, min(case_id) as first from c group by all) select task, count(*)::bigint as calls, count(*) filter (where task <> 'answer' and case_id > first)::bigint as hits, sum(case when task <> 'answer' and case_id > first then 0 else tokens end)::bigint as tokens from c join f using (task, k) group by task")
def cached_tasks(t: Tables) -> DataFrame:
    """Calls, cache hits and used tokens per task: only results of deterministic tasks are cached, and a hit uses nothing."""
    c = observations(t).select("case_id", F.expr(TASK).alias("task"), "k", F.floor("latency").alias("tokens"))
    first = c.groupBy("task", "k").agg(F.min("case_id").alias("first"))
    hit = F.col("task").isin(*CACHED_TASKS) & (F.col("case_id") > F.col("first"))
    return c.join(first, ["task", "k"]).groupBy("task").agg(F.count(F.lit(1)).alias("calls"), F.count_if(hit).alias("hits"), F.sum(F.when(hit, F.lit(0)).otherwise(F.col("tokens"))).cast("long").alias("tokens"))


@query(f"with {OBS}, fk as (select run_id, min(case_id) as forked from ob where event_type = 'error' group by run_id) select ob.run_id + 1000000 as run_id, ob.run_id as lineage, k as slot, max(case_id) as case_id from ob join fk using (run_id) where case_id < forked group by ob.run_id, k")
def fork_ledger(t: Tables) -> DataFrame:
    """What a run that is forked at its first error inherits: the latest effect of every slot before, under the fork's id, with its lineage."""
    o = observations(t)
    fork = o.filter("event_type = 'error'").groupBy("run_id").agg(F.min("case_id").alias("forked"))
    g = o.join(fork, "run_id").filter("case_id < forked").groupBy("run_id", F.col("k").alias("slot")).agg(F.max("case_id").alias("case_id"))
    return g.select((F.col("run_id") + 1_000_000).alias("run_id"), F.col("run_id").alias("lineage"), "slot", "case_id")


ARGUMENTS = {"properties": {"k": {"type": "integer", "minimum": 5, "maximum": 50}, "user": {"type": "string"}}, "required": ["user"]}


@query("select event_id, concat_ws('|', case when json_extract_string(props, '$.k')::int < 5 then 'k: minimum' end, case when json_extract_string(props, '$.k')::int > 50 then 'k: maximum' end, case when json_extract_string(props, '$.user') is null then 'user: missing' end) as problems from events")
def argument_problems(t: Tables) -> DataFrame:
    """Problems of calls' arguments against a schema."""
    return t.events.select("event_id", F.array_join(schema_problems(F.try_parse_json("props"), ARGUMENTS), "|").alias("problems"))


# Words that ask for a date, and what counts as arithmetic.
DATE_WORDS = ("今天", "昨天", "明天", "现在", "日期", "几号", "星期", "时间")
ARITHMETIC = r"[\d+\-*/×÷()（）.]{3,}"
SEQUENCE = ("knowledge_search", "datetime", "calculator")


@query("with d as (select conv_id, turn, text, list_slice([" + ", ".join(f"'{x}'" for x in SEQUENCE) + "], 1, turn // 2) as used from conversations where role = 'user') select conv_id, turn, case when len(used) = 0 then 'knowledge_search' when not list_contains(used, 'datetime') and regexp_matches(text, '" + "|".join(DATE_WORDS) + "') then 'datetime' when not list_contains(used, 'calculator') and regexp_matches(text, '" + ARITHMETIC + "') then 'calculator' else 'answer' end as decision, case when len(used) > 0 then regexp_extract(text, '" + ARITHMETIC + "') else '' end as expression from d")
def tool_decisions(t: Tables) -> DataFrame:
    """Next tool for each question without a model: search first, then the date, then arithmetic, each once; else the answer. A turn has used one tool for each answer before it."""
    d = t.conversations.filter("role = 'user'").withColumn("used", F.slice(F.array(*map(F.lit, SEQUENCE)), 1, F.greatest(F.expr("cast(turn div 2 as int)"), F.lit(0))))
    q = F.col("text")
    decision = F.when(F.size("used") == 0, "knowledge_search").when(~F.array_contains("used", "datetime") & q.rlike("|".join(DATE_WORDS)), "datetime").when(~F.array_contains("used", "calculator") & q.rlike(ARITHMETIC), "calculator").otherwise("answer")
    return d.select("conv_id", "turn", decision.alias("decision"), F.when(F.size("used") > 0, F.regexp_extract("text", ARITHMETIC, 0)).otherwise("").alias("expression"))


#: Longer sentences score nothing whatever they hold, so they are no candidates.
LONGEST = 850
MINE = rf"""s as (select doc_id, unnest({SENT}) as s, generate_subscripts({SENT}, 1) as i from documents),
k as (select doc_id, i, s, list_distinct(regexp_extract_all(lower(s), '[a-z][a-z0-9_\-]{{4,}}')) as ks from s where length(s) between 26 and {LONGEST}),
d as (select doc_id, i, s, list_filter(ks, lambda x: len(list_filter(ks, lambda y: y <> x and contains(y, x))) = 0) as ks from k),
sc as (select doc_id, i, s, len(ks) as n, round(greatest(least(len(ks), 20) * 0.15 + case when regexp_matches(s, '[0-9]') then 0.3 else 0 end + case when length(s) <= 110 then 0.5 else 0 end - case when length(s) > 110 then (length(s) - 110) * 0.005 else 0 end, 0), 6)::double as score from d),
b as (select *, row_number() over (partition by doc_id order by score desc, i) as rn from sc where n > 0 and score > 0)"""


@query(f"with {MINE} select min(doc_id) as doc_id, left(s, 40) as signature, count(*)::bigint as candidates, max(score) as score from b where rn <= 2 group by left(s, 40)")
def mined_cases(t: Tables) -> DataFrame:
    """Evaluation cases mined from sentences: the two densest of each document, the first of every signature."""
    s = extract.densest(t.documents, 2, 26, LONGEST)
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "i")
    best = s.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    return best.groupBy(F.left("s", F.lit(40)).alias("signature")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("candidates"), F.max("score").alias("score"))


# The order of tags on the sheet.
SHEET = ("error", "purchase", "signup", "click", "view")


@query("with " + OBS + ", o as (select event_type as tag, count(*)::bigint as cases, min(case_id) as first_case from ob where support < 0.6 group by event_type) select list_position([" + ", ".join(f"'{x}'" for x in SHEET) + "], tag)::int as place, tag, cases, first_case from o")
def review_sheet(t: Tables) -> DataFrame:
    """Cases to review by primary tag, in fixed order."""
    g = observations(t).filter(F.col("support") < DEFAULT.support_floor).groupBy(F.col("event_type").alias("tag")).agg(F.count(F.lit(1)).alias("cases"), F.min("case_id").alias("first_case"))
    return g.select(F.array_position(F.array(*map(F.lit, SHEET)), F.col("tag")).cast("int").alias("place"), "tag", "cases", "first_case")


@query(f"with {OBS} select case_id, event_type from ob where len(list_filter([event_type, 'k' || (k % 3)], lambda x: list_contains(['error', 'k0'], x))) > 0 order by case_id limit 50 offset 10")
def case_page(t: Tables) -> DataFrame:
    """A page of the cases with any of some tags (skip and limit are the feature)."""
    o = observations(t).filter(F.arrays_overlap(F.array("event_type", F.concat(F.lit("k"), (F.col("k") % 3).cast("string"))), F.array(F.lit("error"), F.lit("k0"))))
    return o.orderBy("case_id").offset(10).limit(50).select("case_id", "event_type")


MARKERS = "|".join(tx.ABSTAIN_MARKERS)


@query(f"with r as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations), l as (select conv_id, text as answer, case when role = 'assistant' then 'answered' else 'no_knowledge' end as outcome from r where back = 1) select conv_id, outcome, outcome in ('no_knowledge', 'insufficient_evidence', 'clarify') or regexp_matches(answer, '{MARKERS}') as abstained from l")
def abstentions(t: Tables) -> DataFrame:
    """Conversations whose last word is no answer: by a marker phrase, or by an outcome; one that ends with a question has none."""
    last = t.conversations.groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("l"))
    rows = last.select("conv_id", F.col("l.text").alias("answer"), F.when(F.col("l.role") == "assistant", "answered").otherwise("no_knowledge").alias("outcome"))
    return rows.select("conv_id", "outcome", tx.abstains(F.col("answer"), F.col("outcome")).alias("abstained"))


@query("""select source, count(*)::bigint as n_docs, sum(greatest(ceil((length(text) - 800) / 700.0), 0)::bigint + 1)::bigint as n_leaves from documents where length(text) > 0 group by source""")
def corpus_leaves(t: Tables) -> DataFrame:
    """Documents and leaf chunks per source."""
    n = F.size(split.strides(F.col("text"), 800, 700))
    return t.documents.filter(F.length("text") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).cast("long").alias("n_leaves"))


@query("""select user_id, event_type, event_id as first_id, n::bigint as seen from (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as rn, count(*) over (partition by user_id, event_type) as n from events) where rn = 1""")
def first_evidence(t: Tables) -> DataFrame:
    """The first of each piece of evidence that a conversation gathers again and again; an aggregate, so no window over a hot user."""
    first = F.min_by("event_id", F.struct("ts", "event_id"))
    return t.events.groupBy("user_id", "event_type").agg(first.alias("first_id"), F.count(F.lit(1)).alias("seen"))


@query("select doc_id from documents where length(text) > 0 and doc_id not in (select doc_id from labels where doc_id is not null)")
def unindexed_leaves(t: Tables) -> DataFrame:
    """Documents that a stored index of the labelled ones doesn't hold yet: what an idempotent add takes."""
    labelled = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi")
    held = t.stored_index("labelled", "documents", labelled).store.read("documents").select("doc_id")
    return t.documents.filter(F.length("text") > 0).join(held, "doc_id", "left_anti").select("doc_id")


#: Records of several writers, made of an event's own fields: other key names, a count or a list, nulls, and no JSON at all.
RECORDS = """case event_type when 'click' then '{"failed_calls": ' || k || ', "answer_id": "a' || k || '"}' when 'error' then '{"failures": ["' || k || '", "x"], "answerId": "b' || k || '"}' when 'view' then '{"failures": [], "id": "c' || k || '", "answer_id": null}' else 'no json: ' || props end"""


@query("select event_id, case event_type when 'click' then k when 'error' then 2 when 'view' then 0 end::bigint as n_failed, case event_type when 'click' then 'a' || k when 'error' then 'b' || k when 'view' then 'c' || k end as answer_id from (select *, json_extract_string(props, '$.k')::int as k from events)")
def loose_fields(t: Tables) -> DataFrame:
    """Records with alternative key names: the first key that is there, and a count that may be a number or a list."""
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).select("event_id", F.expr(RECORDS).alias("record"))
    v = F.try_parse_json("record")
    at = lambda key, kind: F.try_variant_get(v, f"$.{key}", kind)
    n = F.coalesce(at("failed_calls", "bigint"), F.size(at("failed_calls", "array<variant>")).cast("long"), at("failures", "bigint"), F.size(at("failures", "array<variant>")).cast("long"))
    return rows.select("event_id", F.when(v.isNotNull(), n).alias("n_failed"), F.coalesce(*(at(k, "string") for k in ("answer_id", "answerId", "id"))).alias("answer_id"))
