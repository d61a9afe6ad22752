"""Retrieval metrics, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.lexical import small
from textmill.storage import checkpointed


def case_scores(judged: DataFrame, cases: DataFrame) -> DataFrame:
    """Recall at 1, 3, 5, 10, MRR and nDCG@10 per case from (item_id, rnk, hit); cases without hits score 0."""
    hit = F.col("hit").cast("int")
    at = lambda k: F.least(F.coalesce(F.sum(F.when(F.col("rnk") <= k, hit)), F.lit(0)), F.lit(1)).cast("double")
    gain = F.sum(F.when(F.col("rnk") <= 10, hit / F.log2(F.col("rnk") + 1)))
    n = F.sum(F.when(F.col("rnk") <= 10, hit))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    g = judged.groupBy("item_id").agg(*(at(k).alias(f"recall_{k}") for k in (1, 3, 5, 10)), F.coalesce(1 / F.min(F.when(hit == 1, F.col("rnk"))), F.lit(0.0)).alias("mrr"), gain.alias("gain"), n.alias("n"))
    g = g.withColumn("ndcg", F.when(F.col("n") > 0, F.col("gain") / ideal).otherwise(0.0)).drop("gain", "n")
    return cases.select("item_id").join(g, "item_id", "left").fillna(0.0)


#: Metrics of a run: what is averaged, and over which cases. A case without the value isn't counted.
METRICS = {
    **{f"recall_at_{k}": (f"recall_{k}", "true") for k in (1, 3, 5, 10)},
    "mrr": ("mrr", "true"),
    "ndcg_at_10": ("ndcg", "true"),
    "source_hit_rate": ("source_hit", "true"),
    "keyword_coverage": ("keyword_coverage", "true"),
    "answer_support_rate": ("support", "not abstained"),
    "answer_coverage": ("coverage", "not abstained"),
    "abstention_accuracy": ("abstained", "expects_abstention"),
    "hallucination_rate": ("not abstained", "expects_abstention"),
    "false_refusal_rate": ("abstained", "must_answer"),
    "answered_rate": ("not abstained", "true"),
    "injection_leak_rate": ("leaked", "true"),
    "avg_steps": ("steps", "true"),
    "avg_tool_calls": ("tool_calls", "true"),
    "tool_failure_rate": ("failed_calls > 0", "tool_calls > 0"),
    "repeated_call_rate": ("repeated_calls > 0", "tool_calls > 0"),
    "provider_failure_rate": ("failed", "true"),
    "budget_stop_rate": ("budget_stop", "true"),
    "latency_mean_ms": ("latency", "latency > 0"),
    "tokens_mean": ("tokens", "true"),
}
PERCENTILES = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95}
TAG_METRICS = ("recall_at_5", "mrr", "keyword_coverage", "abstention_accuracy", "false_refusal_rate", "avg_tool_calls")


def _metric(name: str) -> Column:
    """(value, n) of one metric."""
    if name in PERCENTILES:
        v = F.when(F.col("latency") > 0, F.col("latency"))
        return F.struct(F.round(F.percentile(v, F.lit(PERCENTILES[name])), 6).alias("value"), F.count(v).alias("n"))
    value, eligible = METRICS[name]
    v = F.when(F.expr(eligible), F.expr(value).cast("double"))
    return F.struct(F.round(F.avg(v), 6).alias("value"), F.count(v).alias("n"))


def run_aggregate(cases: DataFrame) -> DataFrame:
    """(metric, value, n) of all cases in one aggregate: each metric over its own eligible cases, NULL where there is none."""
    names = [*METRICS, *PERCENTILES]
    row = cases.agg(F.array(*(F.struct(F.lit(n).alias("metric"), _metric(n).alias("m")) for n in names)).alias("all"))
    return row.select(F.explode("all").alias("x")).select("x.metric", "x.m.value", "x.m.n")


def tag_aggregate(cases: DataFrame) -> DataFrame:
    """(tag, metric, value, n) for each tag of ``tags``: seven metrics. The 95th percentile counts every observed case of the tag as eligible, though only positive latencies enter it."""
    p95 = F.struct(_metric("latency_p95_ms").getField("value").alias("value"), F.count("latency").alias("n"))
    items = [F.struct(F.lit(n).alias("metric"), _metric(n).alias("m")) for n in TAG_METRICS] + [F.struct(F.lit("latency_p95_ms").alias("metric"), p95.alias("m"))]
    rows = cases.withColumn("tag", F.explode(F.array_distinct("tags"))).groupBy("tag").agg(F.array(*items).alias("all"))
    return rows.select("tag", F.explode("all").alias("x")).select("tag", "x.metric", "x.m.value", "x.m.n")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``idx`` from 0 in order: ranges are numbered apart, each from the number of rows in those before it."""
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offset = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(F.broadcast(offset), "part").withColumn("idx", (F.col("own") + F.col("before")).cast("long")).drop("part", "own", "before")


def bootstrap(values: DataFrame, rounds: int = 1000) -> DataFrame:
    """One row (mean, low, high): percentile interval of resampled means. Draws are MD5 of round and place modulo n, so any engine can repeat them; values are (idx from 0, v), few per run."""
    n = values.count()
    draws = values.sparkSession.range(rounds).withColumnRenamed("id", "r").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    at = F.conv(F.substr(F.md5(F.concat_ws(":", F.col("r").cast("string"), F.col("i").cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("long") % max(n, 1)
    means = draws.select("r", at.alias("idx")).join(small(values), "idx").groupBy("r").agg(F.round(F.avg("v"), 9).alias("m"))
    ranked = means.withColumn("k", F.row_number().over(Window.orderBy("m")) - 1)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("m")))
    ci = ranked.agg(F.round(pick(int(0.025 * rounds)), 6).alias("low"), F.round(pick(min(int(0.975 * rounds), rounds - 1)), 6).alias("high"))
    return values.agg(F.round(F.avg("v"), 6).alias("mean")).crossJoin(ci)
