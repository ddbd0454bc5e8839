"""Rerank retrieved candidates and keep the best ``top_n``.

Default pair scorer (lexical stand-in for a cross-encoder):
    score = sum of idf of query terms present in the node
            / sum of idf of query terms (terms absent from the corpus left out)
rounded to 6 decimals; zero denominator -> 0. Ties by the retrieval rank,
then node id.

The candidate list is small (k per query) and is written *before* the
scorer runs, so the scorer sees k rows per query, never the corpus. Node
text is fetched late, for the candidates alone (``operators/fetch.py``).

A model scorer plugs in as ``make_scorer() -> (queries: list[str], texts:
list[str]) -> list[float]`` and runs in ``mapInPandas`` (made once per
Python worker process, called per Arrow batch).
"""

from __future__ import annotations

from typing import Callable, Optional

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.rank import round_score, top_k
from quarry.functions.text import words
from quarry.operators.fetch import hit_nodes
from quarry.operators.index import TextIndex
from quarry.operators.sparse import query_term_idf



def attach_text(cands: DataFrame, nodes: DataFrame, cols=("text",), key: str = "node_id") -> DataFrame:
    """Node columns for a candidate list, from the nodes fetched for it (``hit_nodes``)."""
    return nodes.select(key, *cols).join(cands, key)


def lexical_scores(cands: DataFrame, queries: DataFrame, index: TextIndex, nodes: DataFrame, text_col: str = "text",
                   key: str = "query_id") -> DataFrame:
    """Default E1 scores for (key, node_id, rank) candidates."""
    qidf = query_term_idf(queries, index, "text", key)
    qlist = qidf.groupBy(key).agg(F.collect_list(F.struct("term", "idf")).alias("_qt"),
                                  F.sum("idf").alias("_tot"))
    with_text = attach_text(cands, nodes, (text_col,))
    with_terms = with_text.withColumn("_nt", F.array_distinct(words(text_col)))
    j = with_terms.join(qlist, key, "left")
    hit = F.aggregate(F.filter(F.coalesce("_qt", F.array().cast("array<struct<term:string,idf:double>>")),
                               lambda e: F.array_contains(F.col("_nt"), e["term"])),
                      F.lit(0.0), lambda a, e: a + e["idf"])
    score = F.when(F.coalesce(F.col("_tot"), F.lit(0.0)) > 0, hit / F.col("_tot")).otherwise(F.lit(0.0))
    return j.withColumn("rerank_score", round_score(score)).drop("_qt", "_tot", "_nt")


def model_scores(cands: DataFrame, queries: DataFrame, nodes: DataFrame, make_scorer: Callable,
                 text_col: str = "text", key: str = "query_id") -> DataFrame:
    """E1 with a pluggable pair scorer, batched through Arrow."""
    with_text = attach_text(cands, nodes, (text_col,))
    pairs = with_text.join(queries.select(key, F.col("text").alias("_qtext")), key)
    schema = T.StructType(pairs.schema.fields + [T.StructField("rerank_score", T.DoubleType())])

    def run(batches):
        scorer = make_scorer()
        for pdf in batches:
            s = scorer(pdf["_qtext"].tolist(), pdf[text_col].tolist())
            yield pdf.assign(rerank_score=pd.Series(s, dtype="float64").round(6).values)

    return pairs.mapInPandas(run, schema).drop("_qtext")


def rerank(cands: DataFrame, queries: DataFrame, index: TextIndex, top_n: int,
           make_scorer: Optional[Callable] = None, text_col: str = "text", key: str = "query_id",
           nodes: Optional[DataFrame] = None) -> DataFrame:
    """Keep ``top_n`` per query. Output: key, node_id, score (retrieval),
    retrieval_rank, rerank_score, rank. Scores see ``text_col`` of the node
    (E3: the sentence, not the window). ``nodes``: the candidates' nodes, if fetched already."""
    c = cands.select(key, "node_id", "score", F.col("rank").alias("retrieval_rank"))
    nodes = hit_nodes(c, index) if nodes is None else nodes
    if make_scorer is None:
        scored = lexical_scores(c, queries, index, nodes, text_col, key)
    else:
        scored = model_scores(c, queries, nodes, make_scorer, text_col, key)
    scored = scored.drop(text_col)
    return top_k(scored, [key], top_n, score="rerank_score", extra_order=[F.col("retrieval_rank").asc()])
