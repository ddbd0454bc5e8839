"""Turn ranked nodes into a context per query.

All inputs here are per-query lists of at most top_k rows, so the windows
(partitioned by query) and the per-query ``collect_list`` hold bounded
groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.rank import round_score, top_k
from quarry.functions.text import sentences, space_token_count, space_tokens, words
from quarry.operators.chunk import node_metadata
from quarry.operators.fetch import around, fetch_places, node_places
from quarry.operators.index import TextIndex
from quarry.operators.rerank import attach_text
from quarry.operators.sparse import query_term_idf
from quarry.session import settle


def replace_with_metadata(hits: DataFrame, nodes: DataFrame, key: str = "window",
                          out: str = "text") -> DataFrame:
    """Node text := metadata[key], falling back to the text when the key is
    missing (B3/B4 nodes). ``nodes``: those of the hits (``hit_nodes``)."""
    with_cols = attach_text(hits, nodes, ("text", "window"))
    meta = node_metadata(with_cols)
    return with_cols.withColumn(out, F.coalesce(meta[key], F.col("text"))).drop("window") if out == "text" else \
        with_cols.withColumn(out, F.coalesce(meta[key], F.col("text")))


def repack(hits: DataFrame, order: str = "forward", key: str = "query_id", rank: str = "rank",
           out: str = "ord") -> DataFrame:
    """Order of nodes in the context. forward: rank ascending; reverse:
    best last; sides: odd ranks ascending then even ranks descending."""
    if order == "forward":
        return hits.withColumn(out, F.col(rank))
    if order == "reverse":
        n = F.count(F.lit(1)).over(Window.partitionBy(key))
        return hits.withColumn(out, n - F.col(rank) + 1)
    if order == "sides":
        n = F.count(F.lit(1)).over(Window.partitionBy(key))
        r = F.col(rank)
        return hits.withColumn(out, F.when(r % 2 == 1, (r + 1) / 2).otherwise(n - r / 2 + 1).cast("int"))
    raise ValueError(f"unknown repack order {order!r}")


def source_node(hits: DataFrame, nodes: DataFrame, key: str = "query_id", rank: str = "rank") -> DataFrame:
    """The best node's window and sentence per query. ``nodes``: those of the hits (``hit_nodes``)."""
    best = hits.filter(F.col(rank) == 1).select(key, "node_id")
    with_cols = attach_text(best, nodes, ("text", "window"))
    return with_cols.select(key, "node_id", F.col("window").alias("window"), F.col("text").alias("sentence"))


def template_token_count(template: str) -> int:
    import regex

    body = template.replace("{context_str}", " ").replace("{query_str}", " ")
    return len(regex.findall(r"[^ \t\n\x0b\f\r]+", body))


def budget_context(packed: DataFrame, queries: DataFrame, context_window: int, num_output: int,
                   template: str, key: str = "query_id", ord_col: str = "ord", text: str = "text") -> DataFrame:
    """keep nodes, in order, while the running token count fits

        budget = context_window - num_output - template tokens - query tokens

    (tokens = whitespace tokens). If even the first node is too long, keep
    its first ``budget`` tokens."""
    tmpl = template_token_count(template)
    q = queries.select(key, space_token_count("text").alias("_qtok"))
    j = packed.join(q, key)
    budget = F.lit(context_window - num_output - tmpl) - F.col("_qtok")
    toks = space_token_count(text)
    w = Window.partitionBy(key).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumn("_tok", toks).withColumn("_budget", budget).withColumn("_run", F.sum("_tok").over(w))
    first_cut = (F.col(ord_col) == F.min(ord_col).over(Window.partitionBy(key))) & (F.col("_run") > F.col("_budget"))
    j = j.withColumn("_first_cut", first_cut)
    kept = j.filter((F.col("_run") <= F.col("_budget")) | (F.col("_first_cut") & (F.col("_budget") > 0)))
    cut_text = F.array_join(F.slice(space_tokens(text), 1, F.greatest(F.col("_budget"), F.lit(1))), " ")
    return kept.withColumn(text, F.when(F.col("_first_cut"), cut_text).otherwise(F.col(text))) \
        .drop("_qtok", "_tok", "_budget", "_run", "_first_cut")


def build_context(packed: DataFrame, key: str = "query_id", ord_col: str = "ord", text: str = "text",
                  sep: str = "\n\n", out: str = "context") -> DataFrame:
    """one context string per query from its ordered nodes."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(text).alias("t"))))
    return packed.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias(out))


def compress_context(packed: DataFrame, queries: DataFrame, index: TextIndex, m: int, window_size: int = 3,
                     key: str = "query_id", ord_col: str = "ord") -> DataFrame:
    """E5: extractive compression. The sentences of each packed window node
    (doc sentences pos-w .. pos+w, de-duplicated on (doc_id, pos)) are scored
    with E1's default against the query; the best ``m`` are kept and output
    in the original order (first node ord, then pos).

    Output: key, doc_id, pos, sentence, score, ord_in_context.
    """
    cand = node_places(packed.select(key, "node_id", ord_col), index)
    spans = around(cand, window_size, "spos").groupBy(key, "doc_id", "part", "spos").agg(F.min(ord_col).alias("_ord"))
    spans = settle(spans, "spans")  # at most (queries x k) x (2w + 1) rows
    sents = fetch_places(spans, index, "spos").withColumnRenamed("at_text", "sentence").drop("part")
    qidf = query_term_idf(queries, index, "text", key)
    qlist = qidf.groupBy(key).agg(F.collect_list(F.struct("term", "idf")).alias("_qt"), F.sum("idf").alias("_tot"))
    j = sents.withColumn("_nt", F.array_distinct(words("sentence"))).join(qlist, key, "left")
    hit = F.aggregate(F.filter(F.coalesce("_qt", F.array().cast("array<struct<term:string,idf:double>>")),
                               lambda e: F.array_contains(F.col("_nt"), e["term"])), F.lit(0.0),
                      lambda a, e: a + e["idf"])
    score = round_score(F.when(F.coalesce(F.col("_tot"), F.lit(0.0)) > 0, hit / F.col("_tot")).otherwise(0.0))
    scored = j.withColumn("score", score).withColumn("_sid", F.concat_ws("-", "doc_id", "spos"))
    best = top_k(scored, [key], m, score="score", id_col="_sid",
                 extra_order=[F.col("_ord").asc(), F.col("doc_id").asc(), F.col("spos").asc()])
    w = Window.partitionBy(key).orderBy("_ord", "doc_id", "spos")
    return best.select(key, "doc_id", F.col("spos").cast("int").alias("pos"), "sentence", "score",
                       "_ord", "spos").withColumn("ord_in_context", F.row_number().over(w)) \
        .drop("_ord", "spos")
