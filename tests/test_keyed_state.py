"""Streams with keyed state against batch forms and plain runs, over several batches and restarts."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import state
from textmill.streaming import keyed

EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


@pytest.fixture
def folder():
    return f"/tmp/textmill-tests/keyed-{uuid.uuid4().hex}"


def slices(spark, df, folder, n=3):
    """The rows in ``n`` files of rising time and of rising time of writing."""
    t = F.unix_micros("ts")
    low, high = df.agg(F.min(t), F.max(t)).first()
    for i in range(n):
        a, b = low + (high - low) * i // n, low + (high - low) * (i + 1) // n + (i == n - 1)
        df.filter((t >= a) & (t < b)).coalesce(1).write.mode("append").parquet(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_facts_over_batches_are_those_of_one_table(spark, sf, folder):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    slices(spark, events, f"{folder}/in")
    out = keyed.run_to_end(spark, f"{folder}/in", keyed.closed_facts, f"{folder}/run", EVENTS)
    whole = state.fact_islands(events.select(F.col("user_id").alias("subject"), F.col("event_type").alias("value"), "ts", F.col("event_id").alias("seq")))
    assert rows(out) == rows(whole.filter("valid_until is not null").select(*out.columns))
    held = keyed.held_state(spark, f"{folder}/run", "current").select("key.user_id", "value.value", "value.n")
    assert rows(held) == rows(whole.filter("valid_until is null").select("subject", "value", "observations"))


def test_a_stream_goes_on_where_it_stopped(spark, sf, folder):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").filter("user_id < 20")
    early = events.filter("ts < '2024-01-15'")
    early.coalesce(1).write.parquet(f"{folder}/in")
    keyed.run_to_end(spark, f"{folder}/in", keyed.closed_facts, f"{folder}/run", EVENTS)
    events.filter("ts >= '2024-01-15'").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = keyed.run_to_end(spark, f"{folder}/in", keyed.closed_facts, f"{folder}/run", EVENTS)
    again = keyed.run_to_end(spark, f"{folder}/in", keyed.closed_facts, f"{folder}/run", EVENTS)
    whole = state.fact_islands(events.select(F.col("user_id").alias("subject"), F.col("event_type").alias("value"), "ts", F.col("event_id").alias("seq")))
    assert rows(out) == rows(again) == rows(whole.filter("valid_until is not null").select(*out.columns))


def test_timers_expire_episodes(spark, sf, folder):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    slices(spark, events, f"{folder}/in")
    out = keyed.run_to_end(spark, f"{folder}/in", lambda r: keyed.expired_episodes(r, 7 * 86_400), f"{folder}/run", EVENTS)
    last = events.agg(F.max("ts")).first()[0]
    gone = events.filter(F.col("ts") <= F.lit(last) - F.expr("interval 7 days"))
    assert rows(out.select("user_id", "event_id")) == rows(gone.select("user_id", "event_id"))
    late = out.join(events, ["user_id", "event_id"]).select((F.unix_millis("expired_at") - F.unix_millis("ts")).alias("ms")).agg(F.min("ms"), F.max("ms")).first()
    assert 7 * 86_400_000 <= late[0] <= late[1] <= 7 * 86_400_000 + 1
    held = keyed.held_state(spark, f"{folder}/run", "held").select("key.user_id", "user_map_key.event_id")
    assert rows(held) == rows(events.select("user_id", "event_id").subtract(gone.select("user_id", "event_id")))


class PlainCache:
    def __init__(self, threshold, ttl, capacity):
        self.t, self.ttl, self.n, self.held = threshold, ttl, capacity, {}

    def call(self, now, seq, op, v):
        v = np.array(v) / np.linalg.norm(v)
        if op == "put":
            self.held[seq] = [now, 0, v]
            if len(self.held) > self.n:
                for e in sorted(self.held, key=lambda e: (10 * self.held[e][1] - (now - self.held[e][0]) / 3600, e))[: max(1, self.n // 10)]:
                    del self.held[e]
            return "put", None
        if not self.held:
            return "no_scope", None
        self.held = {e: x for e, x in self.held.items() if now - x[0] <= self.ttl}
        best = max(((round(float(x[2] @ v), 6), -e) for e, x in self.held.items()), default=(-9, 0))
        if best[0] < self.t:
            return "miss", None
        self.held[-best[1]][1] += 1
        return "hit", -best[1]


def test_cache_against_a_plain_one(spark, folder):
    r = np.random.default_rng(5)
    pick, calls, plain, want = random.Random(5), [], {}, {}
    for seq in range(400):
        scope, op = pick.choice("ab"), pick.choice(["put", "get", "get"])
        v, now = r.normal(size=3).tolist(), 1_704_067_200 + 60 * seq
        calls.append((scope, seq, now, op, v))
        want[seq] = plain.setdefault(scope, PlainCache(0.9, 3 * 3600, 12)).call(now, seq, op, v)
    df = spark.createDataFrame(calls, "scope string, seq long, t long, op string, vector array<double>").select("scope", "seq", F.timestamp_seconds("t").alias("ts"), "op", "vector")
    slices(spark, df, f"{folder}/in", 4)
    out = keyed.run_to_end(spark, f"{folder}/in", lambda x: keyed.cached_lookups(x, 0.9, 3 * 3600, 12), f"{folder}/run", df.schema)
    assert {x.seq: (x.outcome, x.entry) for x in out.collect()} == want
    assert {x[0] for x in want.values()} == {"put", "hit", "miss", "no_scope"}
    held = keyed.held_state(spark, f"{folder}/run", "entries").select("key.scope", "user_map_key.entry", "user_map_value.hits")
    assert rows(held) == sorted(((s, e, x[1]) for s, c in plain.items() for e, x in c.held.items()), key=str)


class Held(dict):
    """A state variable of the kinds that ``Episodes`` uses."""

    appendList = lambda self, xs: self.update({(e,): (at,) for e, at in xs})
    get = lambda self: iter([(e, at) for (e,), (at,) in self.items()])
    iterator = lambda self: iter(list(self.items()))
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class Handle:
    def __init__(self):
        self.timers, self.most = set(), 0

    def getListState(self, *a):  # noqa: N802
        return Held()

    getMapState = getListState

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.most = max(self.most, len(self.timers))

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_a_user_has_one_timer_however_many_episodes():
    import pandas as pd

    handle, e = Handle(), keyed.Episodes(1000)
    e.init(handle)
    times = [1_000_000 + 10 * i for i in range(50)]
    list(e.handleInputRows((7,), iter([pd.DataFrame({"event_id": range(50), "ts": pd.to_datetime(times, unit="ms")})]), Now(0)))
    got, fired = [], 0
    for water in (1_000_500, 1_001_105, 1_001_105, 1_009_999):
        for at in sorted(t for t in handle.timers if t <= water):
            handle.timers.discard(at)
            fired += 1
            for out in e.handleExpiredTimer((7,), Now(water), Now(at)):
                got += [(x.event_id, x.expired_at.value // 1_000_000) for x in out.itertuples()]
        assert len(e.fresh) == 0 and {k[0] for k in e.held} == {i for i, t in enumerate(times) if t + 1000 > water}
    assert got == [(i, t + 1000) for i, t in enumerate(times)]
    assert handle.most == 1 and fired == 3 and not handle.timers
