"""Seams for models: a scorer of (question, text) pairs, an embedder of texts. Both are made once per worker and see Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def model_rerank(hits: DataFrame, make: Callable[[], Callable[[Sequence[tuple[str, str]]], Sequence[float]]], limit: int = 20, floor: float | None = None) -> DataFrame:
    """Hits (item_id, doc_id, rnk, question, text) with ``model_score`` and ``pos``: the first ``limit`` of each item by the model's score, the others behind them in their order with score 0. Scores under ``floor`` go. Only the head is sent to the model; null texts count as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in batches:
            yield pd.Series([float(x) for x in model(list(zip(q.fillna(""), t.fillna(""))))], dtype="float64")

    head = hits.filter(F.col("rnk") <= limit).withColumn("model_score", score("question", "text"))
    if floor is not None:
        head = head.filter(F.col("model_score") >= floor)
    rows = head.unionByName(hits.filter(F.col("rnk") > limit).withColumn("model_score", F.lit(0.0)))
    order = [(F.col("rnk") > limit).cast("int"), F.when(F.col("rnk") > limit, F.col("rnk")).otherwise(0), F.desc("model_score"), F.col("doc_id")]
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))


def model_vectors(docs: DataFrame, make: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(vec_id, embedding) of texts; a null text is an empty one."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for t in batches:
            yield pd.Series([[float(x) for x in v] for v in model(list(t.fillna("")))])

    return docs.select(F.col(id_col).alias("vec_id"), embed(text_col).alias("embedding"))
