"""Keyed state of streams: facts, episodes that expire, and a semantic cache, with timers and a reader of what is held.

Every operator is a processor over one key whose state lives in the state
store, so a key's rows may come in any number of batches and a lost executor
takes its state up from the checkpoint. Rows of a batch are taken in the order
of their time and number. Expiry is by event time: a timer fires once the
watermark has passed it, also for keys that get no rows any more.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textmill.config import DEFAULT

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FACTS = "subject long, value string, valid_from timestamp, valid_until timestamp, observations long"
EPISODES = "user_id long, event_id long, expired_at timestamp"
LOOKUPS = "scope string, seq long, op string, outcome string, entry long, score double, held long"


def _ms(ts: pd.Timestamp) -> int:
    """Milliseconds of a time, rounded up: a timer never fires early."""
    return -(-int(ts.value) // 1_000_000)


def _ordered(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


class Facts(StatefulProcessor):
    """The value that holds for a subject, since when and how often it was seen; the next different one closes it. A row from before the current fact changes nothing but the count of its value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "value string, since timestamp, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        now, out = self.current.get() if self.current.exists() else None, []
        for ts, value in _ordered(rows, "ts", "event_id")[["ts", "event_type"]].itertuples(index=False):
            if now is None:
                now = (value, ts, 1)
            elif value == now[0]:
                now = (value, now[1], now[2] + 1)
            elif ts >= pd.Timestamp(now[1]):
                out.append((key[0], now[0], pd.Timestamp(now[1]), ts, now[2]))
                now = (value, ts, 1)
        self.current.update(now)
        yield pd.DataFrame(out, columns=["subject", "value", "valid_from", "valid_until", "observations"])

    def close(self) -> None:
        """Nothing to close."""


class Episodes(StatefulProcessor):
    """Episodes of a user by number, each expiring ``ttl`` after its time; what expires comes out once.

    What a batch brings is appended to ``fresh`` in one call. A user has one
    timer: past the watermark while something is fresh, else at the least expiry
    held. When it fires, all that the watermark has passed goes in one pass, and
    what is fresh and hasn't expired moves to ``held``.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fresh = handle.getListState("fresh", "event_id long, expires long")
        self.held = handle.getMapState("held", "event_id long", "expires long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        self.fresh.appendList([(int(event), _ms(ts) + self.ttl) for ts, event in _ordered(rows, "ts", "event_id")[["ts", "event_id"]].itertuples(index=False)])
        soon, timers = max(timerValues.getCurrentWatermarkInMs(), 0) + 1, list(self.handle.listTimers())
        if soon not in timers:
            for at in timers:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(soon)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        # of a number that comes again, the last time counts
        stored, fresh = {k[0]: v[0] for k, v in self.held.iterator()}, dict(self.fresh.get())
        due = stored | fresh
        left = {event: at for event, at in due.items() if at > now}
        for event in stored:
            if event not in left:
                self.held.removeKey((event,))
        for event in fresh:
            if event in left:
                self.held.updateValue((event,), (left[event],))
        self.fresh.clear()
        if left:
            self.handle.registerTimer(min(left.values()))
        gone = sorted((at, event) for event, at in due.items() if at <= now)
        yield pd.DataFrame({"user_id": key[0], "event_id": [e for _, e in gone], "expired_at": pd.to_datetime([at for at, _ in gone], unit="ms")})

    def close(self) -> None:
        """Nothing to close."""


class Cache(StatefulProcessor):
    """Entries of one scope: a lookup takes the entry of the best cosine if that reaches the threshold and the entry is younger than ``ttl``; a put that exceeds the capacity evicts a tenth, the least used and oldest first."""

    def __init__(self, threshold: float, ttl_ms: int, capacity: int) -> None:
        self.threshold, self.ttl, self.capacity = threshold, ttl_ms, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "entry long", "created long, hits long, vector array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        held = {k[0]: [v[0], v[1], np.array(v[2])] for k, v in self.entries.iterator()}
        stored, changed, out = set(held), set(), []
        for ts, seq, op, vector in _ordered(rows, "ts", "seq")[["ts", "seq", "op", "vector"]].itertuples(index=False):
            now, seq = _ms(ts), int(seq)
            if op == "put":
                v = np.array(vector, float)
                held[seq] = [now, 0, v / max(np.linalg.norm(v), 1e-300)]
                changed.add(seq)
                if len(held) > self.capacity:
                    # what is worth keeping: ten for a hit, one less for an hour
                    worth = sorted(held, key=lambda e: (held[e][1] * 10.0 - (now - held[e][0]) / 3_600_000.0, e))
                    for e in worth[: max(1, self.capacity // 10)]:
                        del held[e]
                out.append((key[0], seq, op, "put", None, None, len(held)))
                continue
            outcome, entry, score = self._lookup(held, np.array(vector, float), now)
            if outcome == "hit":
                held[entry][1] += 1
                changed.add(entry)
            out.append((key[0], seq, op, outcome, entry, score, len(held)))
        for e in stored - set(held):
            self.entries.removeKey((e,))
        for e in changed & set(held):
            self.entries.updateValue((e,), (held[e][0], held[e][1], held[e][2].tolist()))
        yield pd.DataFrame(out, columns=["scope", "seq", "op", "outcome", "entry", "score", "held"]).astype({"entry": "Int64", "score": "Float64"})

    def _lookup(self, held: dict, vector: np.ndarray, now: int) -> tuple[str, int | None, float | None]:
        if not held:
            return "no_scope", None, None
        for e in [e for e, x in held.items() if now - x[0] > self.ttl]:
            del held[e]
        unit = vector / max(np.linalg.norm(vector), 1e-300)
        best = max(((round(float(x[2] @ unit), 6), -e) for e, x in held.items()), default=None)
        if best is None or best[0] < self.threshold:
            return "miss", None, None
        return "hit", -best[1], best[0]

    def close(self) -> None:
        """Nothing to close."""


# the driver starts a worker of its own for a processor, which may not find this package: processors travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def closed_facts(events: DataFrame) -> DataFrame:
    """Facts of users (event types) as the next one closes them; see ``Facts``."""
    return _with_state(events.select("user_id", "event_id", "ts", "event_type"), "user_id", Facts(), FACTS, "None")


def expired_episodes(events: DataFrame, ttl_s: int = DEFAULT.episode_ttl_s, late: str = "0 seconds") -> DataFrame:
    """(user_id, event_id, expired_at) of episodes whose time-to-live the watermark has passed."""
    return _with_state(events.select("user_id", "event_id", "ts").withWatermark("ts", late), "user_id", Episodes(1000 * ttl_s), EPISODES, "EventTime")


def cached_lookups(calls: DataFrame, threshold: float = DEFAULT.cache_threshold, ttl_s: int = DEFAULT.cache_ttl_s, capacity: int = 512) -> DataFrame:
    """The outcome of every put and get; ``calls`` has scope, seq, ts, op ("put" or "get") and vector."""
    return _with_state(calls.select("scope", "seq", "ts", "op", "vector"), "scope", Cache(threshold, 1000 * ttl_s, capacity), LOOKUPS, "None")


def run_to_end(spark: SparkSession, source: str, make: Callable[[DataFrame], DataFrame], folder: str, schema: str, files: int = 1) -> DataFrame:
    """Runs an operator over all files of a folder, ``files`` a batch, as a stream with its checkpoint and its output in ``folder``; returns the output. A run that was stopped goes on."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        out = make(rows)
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def held_state(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What a stream of ``run_to_end`` holds: the state variable of that name, key and value as structs."""
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint")
