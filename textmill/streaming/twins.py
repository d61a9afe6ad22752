"""Structured Streaming forms of the stateful batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def failure_rate(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and failure rate by window and type; rows later than the watermark are dropped, windows close behind it."""
    w = F.window("ts", window)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("int")).alias("failure_rate"))
    return g.select(F.col("w.start").alias("day"), "event_type", "n", "failure_rate")


FACT = "subject long, value string, valid_from timestamp, valid_until timestamp, observations long"


def fact_stream(events: DataFrame, ttl: str | None = None) -> DataFrame:
    """Closed facts as they are superseded: the state of a subject is its current value, since when and how often.

    Rows of one trigger are taken in order of time and id; a late row doesn't
    reopen a closed fact. With a time-to-live, the state of a silent subject is
    dropped and its fact closed.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            value, since, n = state.get
            out.append((key[0], value, pd.Timestamp(since), pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"), n))
            state.remove()
        else:
            current = state.get if state.exists else None
            rows = pd.concat(frames).sort_values(["ts", "event_id"])
            for ts, value in zip(rows["ts"], rows["event_type"]):
                if current is None:
                    current = (value, ts.isoformat(), 1)
                elif value == current[0]:
                    current = (value, current[1], current[2] + 1)
                elif ts >= pd.Timestamp(current[1]):
                    out.append((key[0], current[0], pd.Timestamp(current[1]), ts, current[2]))
                    current = (value, ts.isoformat(), 1)
            state.update(current)
            if ttl:
                state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + int(pd.Timedelta(ttl).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["subject", "value", "valid_from", "valid_until", "observations"])

    timeout = GroupStateTimeout.EventTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    rows = events.withWatermark("ts", "1 hour") if ttl else events
    return rows.groupBy("user_id").applyInPandasWithState(run, FACT, "value string, since string, n long", "append", timeout)


def run_effects_once(effects: DataFrame, ledger: str, checkpoint: str, slots: tuple[str, ...] = ("run_id", "slot")) -> object:
    """Starts a query that adds each effect's slot to a Parquet ledger once, over restarts and replayed batches too."""

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(*slots).agg(F.min("event_id").alias("event_id"))
        try:
            known = spark.read.parquet(ledger).filter(F.col("epoch") != epoch)
            first = first.join(known, list(slots), "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        # one folder per epoch, overwritten, so a replayed batch leaves the same rows
        first.write.mode("overwrite").parquet(f"{ledger}/epoch={epoch}")

    return effects.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
