"""Plan-shape checks: the physical plans stay the ones the
scale design relies on."""

import uuid

from pyspark.sql import functions as F

from quarry.config import RagConfig
from quarry.operators.chunk import sentence_window_nodes
from quarry.operators.dense import dense_top_k
from quarry.operators.sparse import bm25_top_k
from quarry.sources.index_store import ensure_index

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_b2_has_no_exchange(spark):
    p = plan(sentence_window_nodes(spark.read.parquet(f"{SF}/documents.parquet"), 3))
    assert "Exchange" not in p and "Generate" in p


def test_bm25_scores_nodes_in_place(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    idx = ensure_index(spark, docs, "p", RagConfig().but(layout={"partitions": 2}), path=f"{scratch}/{uuid.uuid4().hex[:6]}")
    q = spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    p = plan(bm25_top_k(q, idx, 12))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert "WindowGroupLimit" in p
    assert "hashpartitioning(query_id" in p and "node_id" not in "".join(
        line for line in p.splitlines() if "hashpartitioning" in line)  # no exchange of (query, node) pairs
    assert "ReadSchema: struct<node_id:string,terms:array<string>,tfs:array<int>,dl:int>" in p


def test_dense_has_no_cross_join(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = e.select("vec_id", F.col("embedding").alias("vector"))
    p = plan(dense_top_k(q, c, 5, id_col="vec_id", exclude_self=True))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
    assert "WindowGroupLimit" in p and "MapInPandas" in p
