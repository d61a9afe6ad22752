"""Stateful operators over ordered rows that need more than a window frame, with memory independent of a group's size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def budget_guard(calls: DataFrame, limit: float) -> DataFrame:
    """(key, seq, cost, admitted, used): a call that would exceed the limit is refused and adds nothing; later, cheaper ones may pass.

    Rows are dealt by key, sorted, and streamed; a key's running total is all
    the state there is.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used = None, 0.0
        for f in frames:
            admitted, total = [], []
            for key, cost in zip(f["key"], f["cost"]):
                if key != at:
                    at, used = key, 0.0
                ok = used + cost <= limit
                used = round(used + cost, 6) if ok else used
                admitted.append(ok)
                total.append(used)
            yield f.assign(admitted=admitted, used=total)

    rows = calls.select("key", "seq", F.col("cost").cast("double").alias("cost"))
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, "key long, seq long, cost double, admitted boolean, used double")


def fact_islands(facts: DataFrame) -> DataFrame:
    """(subject, value, valid_from, valid_until, observations, confidence): equal values in a row are one fact; the next one closes it."""
    w = Window.partitionBy("subject").orderBy("ts", "seq")
    change = F.when(F.lag("value").over(w).eqNullSafe(F.col("value")), 0).otherwise(1)
    runs = facts.withColumn("change", change).withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = runs.groupBy("subject", "island").agg(F.min("value").alias("value"), F.min("ts").alias("valid_from"), F.count(F.lit(1)).alias("observations"))
    until = F.lead("valid_from").over(Window.partitionBy("subject").orderBy("island"))
    return g.select("subject", "value", "valid_from", until.alias("valid_until"), "observations", F.round(F.least(F.lit(1.0), 0.5 + 0.05 * (F.col("observations") - 1)), 6).alias("confidence"))


def as_of(probes: DataFrame, facts: DataFrame) -> DataFrame:
    """Each probe (subject, ts, pid) with the value of the fact valid then. One union and one running window: no range join."""
    a = facts.select("subject", F.col("valid_from").alias("ts"), F.lit(None).cast("long").alias("pid"), F.col("value"), F.lit(0).alias("kind"))
    b = probes.select("subject", "ts", "pid", F.lit(None).cast("string").alias("value"), F.lit(1).alias("kind"))
    w = Window.partitionBy("subject").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return a.union(b).withColumn("was", F.last("value", ignorenulls=True).over(w)).filter("kind = 1").select("pid", F.col("was").alias("value"))
