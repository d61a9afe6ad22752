"""Queries of memory, versions, logs, caches and budgets; batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions import text as tx
from textmill.operators import dedup, dense, lexical, state
from textmill.plans.registry import Tables, query
from textmill.plans.text_queries import HASH, TOK

ISLANDS = """ch as (select user_id as subject, event_type as value, ts, event_id as seq, case when lag(event_type) over w = event_type then 0 else 1 end as c from events window w as (partition by user_id order by ts, event_id)),
il as (select *, sum(c) over (partition by subject order by ts, seq) as island from ch),
fi as (select subject, island, min(value) as value, min(ts) as valid_from, count(*) as observations from il group by subject, island),
ft as (select subject, value, valid_from, lead(valid_from) over (partition by subject order by island) as valid_until, observations, round(least(1.0, 0.5 + 0.05 * (observations - 1)), 6)::double as confidence from fi)"""


def facts(t: Tables) -> DataFrame:
    """Facts from events: subject user, value event type."""
    return state.fact_islands(t.events.select(F.col("user_id").alias("subject"), F.col("event_type").alias("value"), "ts", F.col("event_id").alias("seq")))


@query(f"with {ISLANDS} select subject, value, epoch_us(valid_from) as valid_from, epoch_us(valid_until) as valid_until, observations::bigint as observations, confidence from ft")
def fact_timeline(t: Tables) -> DataFrame:
    """Bi-temporal history: each fact until the next different one."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return facts(t).select("subject", "value", us("valid_from"), us("valid_until"), "observations", "confidence")


@query(f"with {ISLANDS} select subject, value, observations::bigint as observations from ft where valid_until is null")
def current_facts(t: Tables) -> DataFrame:
    """The facts that hold now."""
    return facts(t).filter("valid_until is null").select("subject", "value", "observations")


@query("select p.event_id as pid, f.event_type as value from (select event_id, user_id, ts - interval 6 hour as ts from events where event_type = 'error') p asof left join (select user_id, ts, event_type from events) f on p.user_id = f.user_id and f.ts <= p.ts")
def asof_validity(t: Tables) -> DataFrame:
    """What held six hours before each error."""
    probes = t.events.filter("event_type = 'error'").select(F.col("user_id").alias("subject"), (F.col("ts") - F.expr("interval 6 hours")).alias("ts"), F.col("event_id").alias("pid"))
    return state.as_of(probes, facts(t))


@query("with r as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) select conv_id, count(*) filter (where back <= 2)::bigint as kept, count(*) filter (where back > 2)::bigint as evicted, coalesce(string_agg(substr(text, 1, 80), '|' order by turn) filter (where back > 2), '') as summary from r group by conv_id")
def last_n_turns(t: Tables) -> DataFrame:
    """The last two turns stay; older ones are compacted to 80 characters each."""
    r = t.conversations.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    old = F.array_sort(F.collect_list(F.when(F.col("back") > 2, F.struct("turn", F.substr("text", F.lit(1), F.lit(80)).alias("s")))))
    return r.groupBy("conv_id").agg(F.count_if(F.col("back") <= 2).alias("kept"), F.count_if(F.col("back") > 2).alias("evicted"), F.array_join(F.transform(old, lambda x: x.s), "|").alias("summary"))


@query("select conv_id, turn, case when role = 'assistant' and row_number() over (partition by conv_id, role order by turn desc) > 1 then '[' || length(text) || ' chars]' else md5(text) end as shown from conversations")
def tool_messages(t: Tables) -> DataFrame:
    """Only the last answer of a conversation stays whole."""
    back = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    shown = F.when((F.col("role") == "assistant") & (F.col("back") > 1), F.concat(F.lit("["), F.length("text").cast("string"), F.lit(" chars]"))).otherwise(F.md5("text"))
    return t.conversations.withColumn("back", back).select("conv_id", "turn", shown.alias("shown"))


@query("select user_id, count(*) filter (where ts > m - interval 7 day)::bigint as alive, count(*) filter (where ts <= m - interval 7 day)::bigint as expired from events, (select max(ts) as m from events) group by user_id")
def ttl_expiry(t: Tables) -> DataFrame:
    """Episodes of seven days and less before the newest event; the interval is half-open."""
    m = t.events.agg(F.max("ts").alias("m"))
    alive = F.col("ts") > F.col("m") - F.expr("interval 7 days")
    return t.events.crossJoin(F.broadcast(m)).groupBy("user_id").agg(F.count_if(alive).alias("alive"), F.count_if(~alive).alias("expired"))


EPISODE = r"lower(trim(regexp_replace(unnest(string_split(regexp_replace(text, '([。！？!?；;.\n])', '\1' || chr(1), 'g'), chr(1))), '\s+', ' ', 'g')))"


@query(rf"with s as (select conv_id, role, {EPISODE} as episode from conversations) select episode, count(*)::bigint as n from s where episode <> '' group by episode having count(*) >= 2 and episode not in (select episode from s where role = 'system')")
def consolidation(t: Tables) -> DataFrame:
    """Episodes, the sentences of turns, that are said twice and more and that no system turn has yet."""
    s = t.conversations.select("role", F.explode(tx.sentences(F.col("text"), "。！？!?；;.\n")).alias("s")).select("role", F.lower(F.trim(F.regexp_replace("s", r"\s+", " "))).alias("episode"))
    known = s.filter("role = 'system'").select("episode").distinct()
    return s.groupBy("episode").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2 and episode <> ''").join(known, "episode", "left_anti")


RECALL = f"q as (select item_id, list_distinct({TOK}) as q from benchmark), qx as (select item_id, len(q) as n, unnest(q) as term from q), m as (select conv_id, turn, least(1.0, 0.5 + 0.1 * turn) as conf, unnest(list_distinct({TOK})) as term from conversations), s as (select item_id, conv_id, turn, round(count(*) / any_value(n) + 0.2 * any_value(conf), 6) as score from qx join m using (term) group by item_id, conv_id, turn)"


@query(f"with {RECALL} select item_id, conv_id, turn, score::double as score from (select *, row_number() over (partition by item_id order by score desc, conv_id, turn) as r from s) where r <= 5")
def recall_score(t: Tables) -> DataFrame:
    """Five best memories per query: token overlap and confidence."""
    q = t.benchmark.select("item_id", F.array_distinct(tx.tokens(F.col("text"))).alias("q"))
    q = lexical.small(q.select("item_id", F.size("q").alias("n"), F.explode("q").alias("term")))
    m = t.conversations.select("conv_id", "turn", F.least(F.lit(1.0), 0.5 + 0.1 * F.col("turn")).alias("conf"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    s = m.join(q, "term").groupBy("item_id", "conv_id", "turn").agg(F.round(F.count(F.lit(1)) / F.first("n") + 0.2 * F.first("conf"), 6).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "conv_id", "turn")
    return s.withColumn("r", F.row_number().over(w)).filter("r <= 5").drop("r")


@query(f"with {ISLANDS} select value as kind, count(*) filter (where valid_until is null)::bigint as valid, count(*) filter (where valid_until is not null)::bigint as superseded, max(observations)::bigint as most from ft group by value")
def memory_stats(t: Tables) -> DataFrame:
    """Facts by kind."""
    return facts(t).groupBy(F.col("value").alias("kind")).agg(F.count_if(F.col("valid_until").isNull()).alias("valid"), F.count_if(F.col("valid_until").isNotNull()).alias("superseded"), F.max("observations").alias("most"))


CACHE = "cs as (select q.vec_id as qid, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as s from embeddings q join embeddings v on v.label = q.label and v.vec_id <> q.vec_id where q.vec_id % 50 = 0), cl as (select qid, arg_max(vec_id, row(s, -vec_id)) as entry, max(s) as score from cs group by qid)"


def cache(t: Tables) -> DataFrame:
    """(qid, entry, score): the best entry of the same scope."""
    best = dense.label_best(t.embeddings.filter("vec_id % 50 = 0"), t.embeddings, own=True)
    return best.select("qid", F.col("vec_id").alias("entry"), "score")


@query(f"with {CACHE} select qid, entry, score, score >= 0.7 as hit from cl")
def cache_lookup(t: Tables) -> DataFrame:
    """Semantic cache: best cosine within the scope over a threshold."""
    return cache(t).withColumn("hit", F.col("score") >= 0.7)


@query(f"with {CACHE} select count(*)::bigint as lookups, count(*) filter (where score >= 0.7)::bigint as hits, round(count(*) filter (where score >= 0.7) / count(*), 6) as hit_rate from cl")
def cache_stats(t: Tables) -> DataFrame:
    """Hit rate of the cache."""
    return cache(t).agg(F.count(F.lit(1)).alias("lookups"), F.count_if(F.col("score") >= 0.7).alias("hits"), F.round(F.count_if(F.col("score") >= 0.7) / F.count(F.lit(1)), 6).alias("hit_rate"))


EVICT = "select event_id, user_id, row_number() over (partition by user_id order by {o}, event_id) as r, count(*) over (partition by user_id) as n from events, (select max(ts) as m from events)"


@query("select user_id, event_id from (" + EVICT.format(o="round(value * 10 - epoch(m - ts) / 3600, 6)") + ") where r <= greatest(1, floor(n * 0.1))")
def cache_eviction(t: Tables) -> DataFrame:
    """A tenth of each scope goes, the least used and oldest first."""
    m = t.events.agg(F.max("ts").alias("m"))
    hours = (F.unix_micros(F.col("m").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6 / 3600
    e = t.events.crossJoin(F.broadcast(m)).withColumn("s", F.round(F.col("value") * 10 - hours, 6))
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("s", "event_id"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return e.filter(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))).select("user_id", "event_id")


@query(f"with {ISLANDS}, r as (select *, row_number() over (partition by subject order by confidence, valid_from) as rn, count(*) over (partition by subject) as n from ft where valid_until is not null) select subject, count(*)::bigint as evicted from r where rn <= n - 20 group by subject")
def capacity_eviction(t: Tables) -> DataFrame:
    """Closed facts beyond 20 a subject go, the least certain and oldest first; current ones never."""
    r = facts(t).filter("valid_until is not null")
    r = r.withColumn("rn", F.row_number().over(Window.partitionBy("subject").orderBy("confidence", "valid_from"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("subject")))
    return r.filter("rn <= n - 20").groupBy("subject").agg(F.count(F.lit(1)).alias("evicted"))


UPS = "up as (select user_id as doc_id, event_id as seq, event_type as digest, event_type = 'error' as deleted from events), lg as (select *, lag(digest) over w as was, lag(deleted) over w as gone from up window w as (partition by doc_id order by seq)), vr as (select doc_id, seq, digest, deleted, sum(case when was is null or digest <> was or deleted <> gone then 1 else 0 end) over (partition by doc_id order by seq) as version, (was is null or digest <> was or deleted <> gone) as change from lg)"


def upserts(t: Tables) -> DataFrame:
    """Events as upserts of one document per user; errors are tombstones."""
    return t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("digest"), (F.col("event_type") == "error").alias("deleted"))


@query(f"with {UPS} select doc_id, seq, version::bigint as version, digest, deleted from vr where change")
def doc_versions(t: Tables) -> DataFrame:
    """Versions: a new one only where something changes."""
    return dedup.versions(upserts(t))


@query(f"with {UPS} select doc_id, max(version)::bigint as version, arg_max(digest, seq) as digest from vr group by doc_id having not arg_max(deleted, seq)")
def active_docs(t: Tables) -> DataFrame:
    """Latest state of documents that aren't deleted."""
    v = dedup.versions(upserts(t)).groupBy("doc_id").agg(F.max("version").alias("version"), F.max_by("digest", "seq").alias("digest"), F.max_by("deleted", "seq").alias("deleted"))
    return v.filter("not deleted").drop("deleted")


@query(f"select doc_id || ':' || h as key from (select doc_id, {HASH} as h from documents) except select doc_id || ':' || h from (select doc_id, {HASH} as h from documents) where doc_id not in (select doc_id from labels where toxic = 1)")
def stale_keys(t: Tables) -> DataFrame:
    """Active cache keys that are valid no more: those of documents that were found toxic."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), tx.content_hash(F.col("text"))).alias("key")
    active = t.documents.select(key).distinct()
    valid = t.documents.join(t.labels.filter("toxic = 1").select("doc_id").distinct(), "doc_id", "left_anti").select(key)
    return active.join(valid, "key", "left_anti")


@query("select user_id, event_id, round(sum(value) over (partition by user_id order by event_id), 6) as used, sum(value) over (partition by user_id order by event_id) > 500 as over from events")
def budget_settlement(t: Tables) -> DataFrame:
    """Running use of a budget."""
    used = F.sum("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return t.events.select("user_id", "event_id", F.round(used, 6).alias("used"), (used > 500).alias("over"))


#: Tokens set aside for a prompt before it is sent.
RESERVED = "case when length(text) > 0 then greatest(1, cast(floor(length(text) / 1.6e0) as bigint)) + 8 else 0 end"


@query(f"select conv_id, frozen, used, calls, greatest(frozen - used, 0) as remaining, used > 200 as over_budget from (select conv_id, coalesce(sum({RESERVED}) filter (where role = 'user'), 0)::bigint as frozen, coalesce(sum(length(text) // 2) filter (where role = 'assistant'), 0)::bigint as used, count(*) filter (where role = 'user')::bigint as calls from conversations group by conv_id)")
def settlements(t: Tables) -> DataFrame:
    """Tokens set aside and used per conversation, what of them is left, and whether the budget of 200 is exceeded. Used are two characters of an answer a token."""
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    g = t.conversations.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(user, F.expr(RESERVED))), F.lit(0)).alias("frozen"), F.coalesce(F.sum(F.when(reply, F.expr("length(text) div 2"))), F.lit(0)).alias("used"), F.count_if(user).alias("calls"))
    return g.select("conv_id", "frozen", "used", "calls", F.greatest(F.col("frozen") - F.col("used"), F.lit(0)).alias("remaining"), (F.col("used") > 200).alias("over_budget"))


@query("""with recursive o as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as r from events),
g as (select user_id, event_id, value, r, value <= 300 as admitted, case when value <= 300 then round(value, 6) else 0.0 end as used from o where r = 1 union all
select o.user_id, o.event_id, o.value, o.r, g.used + o.value <= 300, case when g.used + o.value <= 300 then round(g.used + o.value, 6) else g.used end from g join o on o.user_id = g.user_id and o.r = g.r + 1)
select user_id as key, event_id as seq, value::double as cost, admitted, used::double as used from g""")
def budget_guard(t: Tables) -> DataFrame:
    """Calls admitted while they fit; refused ones don't count."""
    return state.budget_guard(t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("cost")), 300.0)


@query("select user_id as run_id, arg_max(event_type, event_id) as state, max(event_id) as seq, count(*)::bigint as steps from events group by user_id")
def latest_state(t: Tables) -> DataFrame:
    """Latest state of each run in an append-only log."""
    return t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("seq"), F.count(F.lit(1)).alias("steps"))


@query("select user_id as run_id, json_extract_string(props, '$.k')::int as slot, min(event_id) as event_id, count(*)::bigint - 1 as replays from events group by all")
def effects_once(t: Tables) -> DataFrame:
    """Effects by slot: executed once, replayed after that."""
    return t.events.groupBy(F.col("user_id").alias("run_id"), F.get_json_object("props", "$.k").cast("int").alias("slot")).agg(F.min("event_id").alias("event_id"), (F.count(F.lit(1)) - 1).alias("replays"))


@query("select event_id, row_number() over (partition by user_id order by ts, event_id)::bigint as step, (count(*) over (partition by user_id, event_type, json_extract_string(props, '$.k') order by ts, event_id rows unbounded preceding))::bigint as repeats, case when row_number() over (partition by user_id order by ts, event_id) > 40 then 'steps' when count(*) over (partition by user_id, event_type, json_extract_string(props, '$.k') order by ts, event_id rows unbounded preceding) > 2 then 'repeats' else 'go' end as verdict from events")
def loop_limits(t: Tables) -> DataFrame:
    """Steps and repeated calls of a run against their limits."""
    e = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rep = F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type", "k").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("step", step).withColumn("repeats", rep)
    return e.select("event_id", "step", "repeats", F.when(F.col("step") > 40, "steps").when(F.col("repeats") > 2, "repeats").otherwise("go").alias("verdict"))


@query("select time_bucket(interval 1 day, ts)::timestamp as day, event_type, count(*)::bigint as n, round(avg(case when event_type = 'error' then 1.0 else 0 end), 6) as failure_rate from events group by all")
def windowed_failures(t: Tables) -> DataFrame:
    """Batch form of the streaming failure rate by day."""
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    g = t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("failure_rate"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "failure_rate")


@query("select n_name as nation, count(*)::bigint as orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def join_smoke(t: Tables) -> DataFrame:
    """Joins and an aggregate over the star schema."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
