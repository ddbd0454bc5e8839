"""Documents -> nodes.

All chunkers work inside the document's own row with higher-order array
functions and then ``posexplode``: there is no shuffle, the node table keeps
the document table's partitioning, and the same code runs on a stream (A7).

Node table schema (every chunker):
    node_id string, doc_id bigint, pos int, text string, window string
``window`` is the sentence-window metadata (null for B3/B4 chunks);
``metadata`` as a map is derived on demand by :func:`node_metadata`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import RagConfig
from quarry.functions.text import sentences, space_token_count, space_tokens

NODE_COLUMNS = ["node_id", "doc_id", "pos", "text", "window"]


def node_id(doc_id, pos) -> Column:
    """Deterministic node identity ``<doc_id>-<pos>``."""
    return F.concat_ws("-", F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"),
                       F.col(pos).cast("string") if isinstance(pos, str) else pos.cast("string"))


def fingerprint(text="text") -> Column:
    """Content fingerprint of a document."""
    return F.md5(F.col(text) if isinstance(text, str) else text)


def split_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """B1: one row per sentence: doc_id, pos (from 0), sentence."""
    return docs.select("doc_id", F.posexplode(sentences(text)).alias("pos", "sentence"))


def sentence_window_nodes(docs: DataFrame, window_size: int = 3, text: str = "text", windows: bool = True) -> DataFrame:
    """B2: one node per sentence; ``window`` joins sentences pos-w .. pos+w
    (cut at the document edges) with one space. Never crosses documents.
    Without ``windows`` it is null: the planner does not leave out windows that nobody reads."""
    w = int(window_size)
    with_sents = docs.select("doc_id", sentences(text).alias("_s"))
    if not windows:
        rows = with_sents.select("doc_id", F.posexplode("_s").alias("pos", "text"))
        return rows.select(node_id("doc_id", "pos").alias("node_id"), "doc_id", "pos", "text", F.lit(None).cast("string").alias("window"))
    n = F.size("_s")

    def window_of(_x, i):
        lo = F.greatest(i - w, F.lit(0))
        hi = F.least(i + w, n - 1)
        return F.array_join(F.slice("_s", lo + 1, hi - lo + 1), " ")

    exploded = with_sents.select(
        "doc_id",
        F.posexplode(F.arrays_zip(F.col("_s").alias("s"), F.transform("_s", window_of).alias("w"))).alias("pos", "z"))
    return exploded.select(
        node_id("doc_id", "pos").alias("node_id"), "doc_id", "pos",
        F.col("z.s").alias("text"), F.col("z.w").alias("window"))


def token_chunk_nodes(docs: DataFrame, chunk_size: int = 512, chunk_overlap: int = 128,
                      text: str = "text") -> DataFrame:
    """Fixed windows of whitespace tokens with overlap.

    Starts 0, s, 2s, ... (s = size - overlap) up to max(n - overlap - 1, 0);
    chunk = tokens [start, start + size) joined by a space. Empty text -> none.
    """
    if not 0 <= chunk_overlap < chunk_size:
        raise ValueError("need 0 <= chunk_overlap < chunk_size")
    step = chunk_size - chunk_overlap
    toks = docs.select("doc_id", space_tokens(text).alias("_t"))
    n = F.size("_t")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - chunk_overlap - 1, F.lit(0)), F.lit(step)))
    # the chunks are cut before they become rows: a row with all tokens of its document would be copied for each chunk
    chunks = F.transform(starts, lambda start: F.array_join(F.slice("_t", start + 1, F.lit(chunk_size)), " "))
    ex = toks.select("doc_id", F.posexplode(chunks).alias("pos", "text"))
    return ex.select(node_id("doc_id", "pos").alias("node_id"), "doc_id", "pos", "text",
                     F.lit(None).cast("string").alias("window"))


def pack_spans(token_counts, chunk_size: int, chunk_overlap: int) -> list[tuple[int, int]]:
    """B4 fold over one document's per-sentence token counts.

    Returns 0-based inclusive sentence spans. Walk sentences in order; close
    the chunk when adding the next one would pass ``chunk_size`` tokens (a
    longer single sentence forms its own chunk). The next chunk takes back
    whole trailing sentences of the closed one (never its first), last first,
    while their tokens total <= overlap and fit with the new sentence.
    """
    spans: list[tuple[int, int]] = []
    start, tok = 0, 0
    for i, ti in enumerate(token_counts):
        ti = int(ti)
        if tok == 0 or tok + ti <= chunk_size:
            tok += ti
            continue
        spans.append((start, i - 1))
        j, back = i, 0
        while j - 1 >= start + 1:
            tj = int(token_counts[j - 1])
            if back + tj <= chunk_overlap and back + tj + ti <= chunk_size:
                j, back = j - 1, back + tj
            else:
                break
        start, tok = j, back + ti
    if len(token_counts):
        spans.append((start, len(token_counts) - 1))
    return spans


SPAN_TYPE = "array<struct<s:int,e:int>>"


def _pack_spans_udf(chunk_size: int, chunk_overlap: int):

    @F.pandas_udf(SPAN_TYPE)
    def spans(counts: pd.Series) -> pd.Series:
        return pd.Series([[{"s": a, "e": b} for a, b in pack_spans(c if c is not None else [], chunk_size,
                                                                        chunk_overlap)] for c in counts])

    return spans


def sentence_pack_nodes(docs: DataFrame, chunk_size: int = 512, chunk_overlap: int = 128,
                        text: str = "text") -> DataFrame:
    """Chunks of whole sentences up to ``chunk_size`` whitespace tokens."""
    if not 0 <= chunk_overlap < chunk_size:
        raise ValueError("need 0 <= chunk_overlap < chunk_size")
    s = docs.select("doc_id", sentences(text).alias("_s"))
    s = s.select("doc_id", "_s", F.transform("_s", lambda x: space_token_count(x)).alias("_tc"))
    # per-row fold in a vectorised UDF; splitting and token counting stay in the JVM
    spans = s.select("doc_id", "_s", _pack_spans_udf(chunk_size, chunk_overlap)("_tc").alias("_sp"))
    chunks = F.transform("_sp", lambda span: F.array_join(F.slice("_s", span["s"] + 1, span["e"] - span["s"] + 1), " "))
    ex = spans.select("doc_id", F.posexplode(chunks).alias("pos", "text"))
    return ex.select(node_id("doc_id", "pos").alias("node_id"), "doc_id", "pos", "text",
                     F.lit(None).cast("string").alias("window"))


def document_nodes(docs: DataFrame, text: str = "text") -> DataFrame:
    """One node per document (node_id = doc_id as text), for document-level retrieval."""
    return docs.select(F.col("doc_id").cast("string").alias("node_id"), "doc_id", F.lit(0).alias("pos"),
                       F.col(text).alias("text"), F.lit(None).cast("string").alias("window"))


def chunk(docs: DataFrame, cfg: RagConfig, windows: bool = True) -> DataFrame:
    """The config picks the chunker before the plan is built; same schema out."""
    if cfg.chunking.kind == "document":
        return document_nodes(docs)
    if cfg.chunking.kind == "sentence_window":
        return sentence_window_nodes(docs, cfg.chunking.window, windows=windows)
    if cfg.chunking.kind == "token":
        return token_chunk_nodes(docs, cfg.chunking.size, cfg.chunking.overlap)
    return sentence_pack_nodes(docs, cfg.chunking.size, cfg.chunking.overlap)


def node_metadata(nodes: DataFrame) -> Column:
    """Metadata map of a node, derived from plain columns (keeps pruning working)."""
    return F.when(F.col("window").isNotNull(),
                  F.create_map(F.lit("window"), F.col("window"), F.lit("original_sentence"), F.col("text"))
                  ).otherwise(F.create_map().cast("map<string,string>"))


def corpus_counts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row with document and node counts (a global agg: partial per task)."""
    d = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("doc_id").alias("n_docs_with_nodes"))
    return d.select("n_docs", n.select("n_nodes").scalar().alias("n_nodes"),
                    n.select("n_docs_with_nodes").scalar().alias("n_docs_with_nodes"))
