"""Lineage of any depth: whole paths by a recursive query, roots by pointer doubling. Cycles end both."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.storage import checkpointed

LIMITS = ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit")


@contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    """Recursive queries without bounds on levels and rows; the settings before are put back."""
    was = {k: spark.conf.get(k) for k in LIMITS}
    try:
        for k in LIMITS:
            spark.conf.set(k, "-1")
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth, cycle): every node above each start, itself at depth 0; a node that is met again ends its path and is marked.

    ``edges`` has node and parent, of which a node may have several; null parents
    are none. Rows are the sum of the paths' lengths, so starts should be few or
    paths short; ``roots`` doesn't make paths.
    """
    spark, name = edges.sparkSession, uuid.uuid4().hex
    edges.filter("parent is not null").select("node", "parent").distinct().createOrReplaceTempView(f"edges_{name}")
    starts.select("node").filter("node is not null").distinct().createOrReplaceTempView(f"starts_{name}")
    try:
        with _unlimited(spark):
            rows = spark.sql(
                f"""with recursive up(start, node, depth, path, cycle) as (
                select node, node, 0, array(node), false from starts_{name}
                union all select up.start, e.parent, up.depth + 1, array_append(up.path, e.parent), array_contains(up.path, e.parent)
                from up join edges_{name} e on e.node = up.node where not up.cycle)
                select start, node, depth, cycle from up"""
            )
            return checkpointed(rows)
    finally:
        for view in ("edges", "starts"):
            spark.catalog.dropTempView(f"{view}_{name}")


def roots(edges: DataFrame) -> DataFrame:
    """(node, root, depth): the last node above each node of a forest and how far up it is; nodes on or below a cycle have no root.

    Every round each node points twice as far, so rounds grow with the logarithm
    of the depth; rows are one per node. Of several parents the least counts.
    """
    up = edges.filter("node is not null").groupBy("node").agg(F.min("parent").alias("to"))
    tops = up.select(F.col("to").alias("node")).filter("node is not null").join(up.select("node"), "node", "left_anti").distinct().withColumn("to", F.lit(None).cast(edges.schema["node"].dataType))
    state = checkpointed(up.unionByName(tops).select("node", F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("to").isNull().alias("done")))
    n = state.count()
    for _ in range(max(1, n.bit_length() + 1)):
        if state.filter("not done").isEmpty():
            break
        above = state.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ended"))
        state = checkpointed(state.filter("done").unionByName(state.filter("not done").join(above, "to").select("node", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ended").alias("done"))))
    # after that many rounds every path without a cycle has ended
    return state.select("node", F.when(F.col("done"), F.col("to")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))
