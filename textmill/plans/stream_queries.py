"""Queries that run tables as streams to their end: the results are those of the batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.plans.registry import Tables, query
from textmill.plans.state_queries import ISLANDS
from textmill.storage import Conflict, Store, shared_dir
from textmill.streaming import keyed

#: Settings of the cache query.
HIT, CACHE_TTL_S = 0.25, 6000


def streamed(t: Tables, name: str, table: str, rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The output of an operator over the rows as a stream. Rows and checkpoint lie in a folder named by the table's state, so a run that was stopped goes on and one that has ended isn't repeated."""
    store = Store(t.spark, f"{shared_dir(t.spark)}/stream-{name}-{t.state(table)}")
    if not store.version():
        try:
            store.commit(store.manifest(), {"rows": rows})
        except Conflict:  # another session has written them meanwhile
            pass
    source = f"{store.root}/data/{store.manifest(1).parts['rows'][0]}"
    return keyed.run_to_end(t.spark, source, make, f"{store.root}/run", rows.schema, files=1_000_000)


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


@query(f"with {ISLANDS} select subject, value, epoch_us(valid_from) as valid_from, epoch_us(valid_until) as valid_until, observations::bigint as observations from ft where valid_until is not null")
def stream_facts(t: Tables) -> DataFrame:
    """Facts as they are closed, from state that holds the current one of each subject."""
    out = streamed(t, "facts", "events", _events(t), keyed.closed_facts)
    return out.select("subject", "value", F.unix_micros("valid_from").alias("valid_from"), F.unix_micros("valid_until").alias("valid_until"), "observations")


@query("select user_id, event_id from events, (select max(ts) as m from events) where ts <= m - interval 7 day")
def stream_expiry(t: Tables) -> DataFrame:
    """Episodes that timers have expired, seven days after their time."""
    return streamed(t, "expiry", "events", _events(t), lambda rows: keyed.expired_episodes(rows, 7 * 86_400)).select("user_id", "event_id")


@query(f"""with g as (select q.vec_id as seq, q.label, v.vec_id as entry, q.vec_id - v.vec_id <= {CACHE_TTL_S // 60} as young, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score
from embeddings q left join embeddings v on v.label = q.label and v.vec_id < q.vec_id and v.vec_id % 50 <> 0 where q.vec_id % 50 = 0),
b as (select seq, count(entry) as puts, max(score) filter (where young) as best, arg_max(entry, (score, -entry)) filter (where young) as entry from g group by seq)
select seq, case when puts = 0 then 'no_scope' when best >= {HIT} then 'hit' else 'miss' end as outcome, case when best >= {HIT} then entry end as entry, case when best >= {HIT} then best end as score from b""")
def stream_cache(t: Tables) -> DataFrame:
    """A semantic cache in keyed state: every fiftieth vector looks up, the others are put, a minute apart; scopes are labels, entries expire."""
    get = F.col("vec_id") % 50 == 0
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + 60 * F.col("vec_id"))
    calls = t.embeddings.select(F.col("label").cast("string").alias("scope"), F.col("vec_id").alias("seq"), ts.alias("ts"), F.when(get, "get").otherwise("put").alias("op"), F.col("embedding").cast("array<double>").alias("vector"))
    out = streamed(t, "cache", "embeddings", calls, lambda rows: keyed.cached_lookups(rows, HIT, CACHE_TTL_S, 1 << 30))
    return out.filter("op = 'get'").select("seq", "outcome", "entry", "score")
