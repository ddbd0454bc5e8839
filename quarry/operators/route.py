"""Query classification and routing.

G1 default classifier (a lexical stand-in for the model selector): a query
needs retrieval (ind = 0) when its best BM25 score reaches ``threshold``;
otherwise, or with no keyword match at all, ind = 1 (answer directly).
Route order follows the reference: 0 = retrieval-augmented, 1 = direct.
A model classifier plugs in as ``make_classifier() -> (list[str]) -> list[int]``.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.index import TextIndex
from quarry.operators.sparse import keyword_top_k


def classify_by_keyword_score(queries: DataFrame, index: TextIndex, threshold: float,
                              key: str = "query_id") -> DataFrame:
    """G1: (query_id, top_score, route)."""
    top = keyword_top_k(queries, index, 1, key=key).select(key, F.col("score").alias("top_score"))
    j = queries.select(key).join(top, key, "left")
    route = F.when(F.col("top_score").isNotNull() & (F.col("top_score") >= F.lit(float(threshold))), 0).otherwise(1)
    return j.withColumn("route", route.cast("int"))


def classify_with_model(queries: DataFrame, make_classifier: Callable, key: str = "query_id") -> DataFrame:
    """G1 with a pluggable classifier, batched through Arrow."""
    schema = T.StructType([queries.schema[key], T.StructField("route", T.IntegerType())])

    def run(batches):
        fn = make_classifier()
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "route": pd.Series(fn(pdf["text"].tolist()), dtype="int32")})

    return queries.select(key, "text").mapInPandas(run, schema)


def route_counts(routes: DataFrame) -> DataFrame:
    return routes.groupBy("route").agg(F.count(F.lit(1)).alias("n_queries"))
