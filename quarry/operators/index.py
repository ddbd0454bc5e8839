"""Build the dense and keyword halves of an index in one pass.

From one node table, a single map-only projection yields per node the sorted
distinct terms with their counts (in-row, see ``term_frequencies``) and the
length: the forward table, which BM25 can score in place. From it:

    postings       blocks by term (``operators/postings.py``), one shuffle by bucket
    vectors(node_id, doc_id, vector)          no shuffle
    df(term, df)                              groupBy term over the blocks' counts
    stats(n, avgdl, total)                    global agg, one row

``dl`` is stored in every posting, so they can be scored without a join.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import RagConfig
from quarry.operators.embed import Embedder, hashed_vector, with_terms


@dataclass
class TextIndex:
    nodes: DataFrame     # node_id, doc_id, pos, text, part
    postings: DataFrame  # term, node_id, doc_id, pos, tf, dl
    vectors: DataFrame   # node_id, doc_id, vector
    df: DataFrame        # term, df
    stats: DataFrame     # n, avgdl, total
    cfg: RagConfig
    embedder: Embedder
    forward: DataFrame   # node_id, doc_id, pos, terms, tfs, dl, part
    blocks: DataFrame    # the postings as stored: blocks with bounds, v, bucket
    live_posting: Callable[[Column, Column], Column]  # (v, doc_id) -> whether the snapshot holds it
    parts: int           # part = pmod(xxhash64(doc_id), parts)
    buckets: int         # bucket = pmod(xxhash64(term), buckets)

    def n_nodes(self):
        return self.stats.select("n").scalar()

    def avgdl(self):
        return self.stats.select("avgdl").scalar()


def build_forward(nodes: DataFrame, cfg: RagConfig) -> DataFrame:
    """Per-node sorted distinct terms with counts, and the length. The only place where
    node text is tokenised; postings, vectors, df and stats come from it."""
    ts = with_terms(nodes.select("node_id", "doc_id", "pos", "text"), "text", cfg.layout.stemming)
    return ts.select("node_id", "doc_id", "pos", F.col("_ts.terms").alias("terms"),
                     F.col("_ts.tfs").cast("array<int>").alias("tfs"),
                     F.aggregate("_ts.tfs", F.lit(0), lambda a, b: a + b).cast("int").alias("dl"))


def build_vectors(nodes: DataFrame, forward: DataFrame, cfg: RagConfig, embedder: Embedder) -> DataFrame:
    """Nodes without tokens keep a null vector; D1 skips them."""
    if embedder.make_fn is None and embedder.with_stemming == cfg.layout.stemming:
        terms = forward.withColumn("_ts", F.struct("terms", "tfs"))
        return terms.select("node_id", "doc_id", hashed_vector(F.col("_ts"), embedder.dim).alias("vector"))
    return embedder.embed(nodes.select("node_id", "doc_id", "text"), "text").select("node_id", "doc_id", "vector")


def doc_freq(forward: DataFrame) -> DataFrame:
    """term, df: a node lists each of its terms once."""
    return forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(forward: DataFrame) -> DataFrame:
    """n = nodes with at least one token; total = their tokens; avgdl = their mean length:
    one partial aggregate per task."""
    has = F.col("dl") > 0
    sums = forward.agg(F.count(F.when(has, F.lit(1))).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total"))
    return sums.select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("avgdl"), "total")
