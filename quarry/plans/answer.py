"""Answer a whole batch of questions in one Spark plan.

    P1 hybrid + rerank (default)   B2, C1, C3, D8, E1, E2, F4, F3, F1, F8, E6
    P2 hybrid, no rerank           P1 without E1
    P3 dense + rerank              D1 instead of D8
    P4 dense, no rerank            P3 without E1
    P5 routed                      G1 picks RAG (P1..P4) or generation (F7)

Every stage is a DataFrame -> DataFrame function; the config picks the
stages before anything runs, and Catalyst sees one plan for all queries.
"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import RagConfig
from quarry.operators.dense import dense_top_k
from quarry.operators.embed import default_pseudo_document, hyde_vectors
from quarry.operators.fetch import hit_nodes
from quarry.operators.fuse import hybrid_top_k
from quarry.operators.generate import (QA_TEMPLATE, complete, generation_only, make_extractive_completer,
                                       simple_summarize, tree_summarize, written_pseudo_documents)
from quarry.operators.index import TextIndex
from quarry.operators.ledger import Ledger
from quarry.operators.pack import budget_context, build_context, replace_with_metadata, repack, source_node
from quarry.operators.rerank import rerank
from quarry.operators.route import classify_by_keyword_score, classify_with_model
from quarry.operators.sparse import keyword_top_k
from quarry.session import settle


def query_vectors(queries: DataFrame, index: TextIndex, cfg: RagConfig, make_writer: Optional[Callable] = None,
                  call: Callable = complete) -> DataFrame:
    """C2 (and C4, if the config asks for it): query vectors with the index's embedder. ``make_writer``: a
    completer that writes the hypothetical documents (F8); the default is a lexical stand-in."""
    if cfg.search.pseudo_documents:
        q = queries.withColumn("pseudo_doc", default_pseudo_document("text")) if make_writer is None \
            else written_pseudo_documents(queries, make_writer, call)
        return hyde_vectors(q, index.embedder, "pseudo_doc", "text", include_original=True)
    return index.embedder.embed(queries, "text")


def retrieve(queries: DataFrame, index: TextIndex, cfg: RagConfig, make_writer: Optional[Callable] = None,
             call: Callable = complete) -> DataFrame:
    """D8 (hybrid) or D1 (dense): (query_id, node_id, score, rank), top_k per query."""
    qv = query_vectors(queries, index, cfg, make_writer, call)
    dense = dense_top_k(qv, index.vectors, cfg.search.dense)
    if cfg.search.keyword is None:
        return dense
    sparse = keyword_top_k(queries, index, cfg.search.keyword)
    return hybrid_top_k(dense, sparse, cfg.search.dense, cfg.search.keyword_weight, cfg.search.fusion) \
        .select("query_id", "node_id", "score", "rank")


def postprocess(hits: DataFrame, queries: DataFrame, index: TextIndex, cfg: RagConfig, nodes: DataFrame,
                make_scorer: Optional[Callable] = None):
    """E3 order: rerank on the node's own text (the sentence), then swap in
    the window (E2). Returns (ranked ids, nodes with replaced text)."""
    if cfg.context.keep is not None:
        hits = rerank(hits, queries, index, cfg.context.keep, make_scorer, nodes=nodes)
    ranked = hits.select("query_id", "node_id", "rank")
    replaced = replace_with_metadata(ranked, nodes, cfg.context.metadata) \
        .select("query_id", "node_id", "rank", "text")
    return ranked, replaced


ANSWER_FIELDS = ("response", "error", "prompt_tokens", "completion_tokens", "total_tokens")


def generated_answer(queries: DataFrame, make_completer: Callable = make_extractive_completer,
                     call: Callable = complete) -> DataFrame:
    """F7 in the columns of ``answer``: the sources are null."""
    none = F.lit(None).cast("string")
    return generation_only(queries, make_completer, call=call).select(
        "query_id", *ANSWER_FIELDS, none.alias("source_node_id"), none.alias("window"), none.alias("sentence"))


def answer(queries: DataFrame, index: TextIndex, cfg: RagConfig,
           make_completer: Callable = make_extractive_completer,
           make_scorer: Optional[Callable] = None, make_writer: Optional[Callable] = None,
           ledger: Optional[Ledger] = None) -> DataFrame:
    """P1-P4 (by config): query_id, response, source node_id, window, sentence,
    prompt_tokens, completion_tokens, total_tokens, error. With the response mode
    "generation" nothing is retrieved and the source columns are null. With a ledger
    every model call is written before it is used, and none is made twice."""
    call = ledger.complete if ledger is not None else complete
    if cfg.synthesis.mode == "generation":
        return generated_answer(queries, make_completer, call)
    hits = settle(retrieve(queries, index, cfg, make_writer, call), "hits")  # top_k rows per query
    nodes = hit_nodes(hits, index)  # the one scan of the node table; used three times below
    ranked, nodes_out = postprocess(hits, queries, index, cfg, nodes, make_scorer)
    packed = repack(nodes_out, cfg.context.order)
    packed = budget_context(packed, queries, cfg.context.limit, cfg.context.reserved, QA_TEMPLATE)
    src = source_node(ranked, nodes)
    if cfg.synthesis.mode == "tree_summarize":
        k = cfg.context.keep or cfg.search.dense
        tree = tree_summarize(packed, queries, k, cfg.synthesis.fan_in, make_completer, call=call)
        out = queries.select("query_id").join(tree, "query_id", "left").select("query_id", *ANSWER_FIELDS)
    else:
        done = simple_summarize(build_context(packed), queries, make_completer, call=call)
        out = done.select("query_id", *ANSWER_FIELDS)
    return out.join(src.withColumnRenamed("node_id", "source_node_id"), "query_id", "left")


def routed_answer(queries: DataFrame, index: TextIndex, cfg: RagConfig,
                  make_completer: Callable = make_extractive_completer,
                  make_scorer: Optional[Callable] = None, make_classifier: Optional[Callable] = None,
                  make_writer: Optional[Callable] = None, ledger: Optional[Ledger] = None) -> DataFrame:
    """P5 = G1 + G2 + G3: each query runs exactly one branch; sources only on
    the RAG route (ind = 0). Output adds ``route``. G1 is the supplied classifier,
    or else the BM25 threshold; it is asked once, before the branches part."""
    routes = classify_by_keyword_score(queries, index, cfg.synthesis.route_at) if make_classifier is None \
        else classify_with_model(queries, make_classifier)
    routes = settle(routes.select("query_id", "route"), "routes")
    rag_q = queries.join(routes.filter(F.col("route") == 0).select("query_id"), "query_id", "left_semi")
    gen_q = queries.join(routes.filter(F.col("route") == 1).select("query_id"), "query_id", "left_semi")
    rag = answer(rag_q, index, cfg, make_completer, make_scorer, make_writer, ledger).withColumn("route", F.lit(0))
    call = ledger.complete if ledger is not None else complete
    gen = generated_answer(gen_q, make_completer, call).withColumn("route", F.lit(1))
    return rag.unionByName(gen)
