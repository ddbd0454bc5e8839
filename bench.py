"""Benchmark: headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
  {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Timed steps (each runs to completion with a full action):
  index_build   documents -> sentence-window nodes -> postings, vectors, df,
                stats written as parquet tables (A4/A6, fresh path)
  b2_nodes      B2 chunker over all documents (count)
  d1_dense      dense top-5 for every benchmark query
  d2_bm25       BM25 top-12 for every benchmark query
  d8_hybrid     fused hybrid top-5
  p1_answer     P1 end to end (hybrid, rerank, window, prompt, stub completion)
  v4_metrics    document-level BM25 + text qrels + IR metrics
  f9_running    running text over conversations
Warm: the Python workers and JVM are warmed by a first tiny job; each step
is timed once (median of 3 for the retrieval steps).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from quarry.session import local_session, shared_path

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    from quarry.config import RagConfig
    from quarry.operators.chunk import sentence_window_nodes
    from quarry.operators.dense import dense_top_k
    from quarry.operators.evaluate import ir_metrics, text_qrels
    from quarry.operators.fuse import hybrid_top_k
    from quarry.operators.messages import running_text
    from quarry.operators.sparse import keyword_top_k
    from quarry.plans.answer import answer
    from quarry.sources.index_store import ensure_index
    from quarry.sources.tables import benchmark_queries, documents, read_table

    times: dict[str, float] = {}

    def timed(name, fn, reps=1):
        vals = []
        for _ in range(reps):
            t = time.time()
            fn()
            vals.append(time.time() - t)
        times[name] = round(statistics.median(vals), 3)

    spark.range(100).selectExpr("sum(id)").collect()  # warm the JVM
    cfg = RagConfig()
    docs = documents(spark, sf_dir)
    q = benchmark_queries(spark, sf_dir)
    run = uuid.uuid4().hex[:8]
    idx_holder = {}

    def build():
        idx_holder["idx"] = ensure_index(spark, docs, f"bench-{run}", cfg,
                                         path=shared_path(spark, "quarry-bench", run, "sentence"))

    timed("index_build", build)
    idx = idx_holder["idx"]
    timed("b2_nodes", lambda: sentence_window_nodes(docs, 3).count())
    qv = idx.embedder.embed(q, "text").cache()
    qv.count()
    timed("d1_dense", lambda: dense_top_k(qv, idx.vectors, 5).collect(), reps=3)
    timed("d2_bm25", lambda: keyword_top_k(q, idx, 12).collect(), reps=3)

    def hybrid():
        d = dense_top_k(qv, idx.vectors, 5)
        return hybrid_top_k(d, keyword_top_k(q, idx, 12), 5, 0.3, "OR").collect()

    timed("d8_hybrid", hybrid, reps=3)
    timed("p1_answer", lambda: answer(q, idx, cfg).collect())

    def build_documents():
        idx_holder["doc"] = ensure_index(spark, docs, f"bench-doc-{run}", cfg.but(chunking={"kind": "document"}),
                                         path=shared_path(spark, "quarry-bench", run, "document"))

    timed("doc_index_build", build_documents)
    didx = idx_holder["doc"]

    def metrics():
        from pyspark.sql import functions as F
        qrels = text_qrels(q, docs).select("query_id", F.col("doc_id").cast("string").alias("node_id"), "ord")
        return ir_metrics(keyword_top_k(q, didx, 5), qrels, 5).collect()

    timed("v4_metrics", metrics)
    timed("f9_running", lambda: running_text(read_table(spark, sf_dir, "conversations")).count())
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
