"""Fusion, normalising, merging, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.config import DEFAULT


def rrf(channels: DataFrame, k: int = DEFAULT.rrf_k) -> DataFrame:
    """(item_id, doc_id, score, rnk) from (item_id, doc_id, rnk, weight); channels of weight 0 don't count."""
    s = channels.filter("weight > 0").groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rnk"))), 9).alias("score"))
    return s.withColumn("rnk", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))


def minmax(hits: DataFrame) -> DataFrame:
    """Scores within each item from 0 to 1; 1 where all are equal."""
    w = Window.partitionBy("item_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("norm", F.round(F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0), 6))


def pack(units: DataFrame, budget: int = DEFAULT.evidence_chars, overhead: int = DEFAULT.item_overhead) -> DataFrame:
    """(item_id, doc_id, rnk, used): units taken in order while they fit; what overflows is skipped, later ones may fit. A first unit beyond the budget is cut to it. An item's units are the hits of one query, so their list is short."""
    ordered = F.array_sort(F.collect_list(F.struct("rnk", "doc_id", "n")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rnk:int,doc_id:bigint,used:bigint>>").alias("kept"))

    def step(a: object, u: object) -> object:
        cost = u.n.cast("long") + overhead
        fits = a.used + cost <= budget
        alone = (F.size(a.kept) == 0) & (u.rnk == 1) & ~fits
        total = F.when(alone, F.lit(budget).cast("long")).otherwise(a.used + cost)
        entry = F.struct(u.rnk.cast("int").alias("rnk"), u.doc_id.alias("doc_id"), total.alias("used"))
        return F.when(fits | alone, F.struct(total.alias("used"), F.concat(a.kept, F.array(entry)).alias("kept"))).otherwise(a)

    got = units.groupBy("item_id").agg(F.aggregate(ordered, start, step).alias("a"))
    return got.select("item_id", F.explode("a.kept").alias("k")).select("item_id", "k.doc_id", "k.rnk", "k.used")


def union_max(parts: DataFrame) -> DataFrame:
    """Hits of several sub-queries as one list: best score, first position."""
    return parts.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"), F.min("rnk").alias("pos"))
