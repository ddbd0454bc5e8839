"""Registered queries: sources, chunking, index, retrieval, fusion (A, B, C, D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.checks import duckdb_sql as S
from quarry.operators import chunk as C
from quarry.operators.approx import BUCKET, LEAST_BITS, MOST_BITS, TABLES, approx_dense_top_k
from quarry.operators.dense import dense_top_k
from quarry.operators.embed import Embedder, default_pseudo_document, hyde_vectors
from quarry.operators.fuse import fuse, hybrid_top_k, min_max
from quarry.operators.generate import make_first_tokens_questioner, written_pseudo_documents
from quarry.operators.ledger import Ledger
from quarry.operators.sparse import keyword_top_k, query_term_idf, selective_bm25_top_k
from quarry.plans.registry import DEFAULT_CFG, corpus_index, register, with_sql
from quarry.sources.tables import benchmark_queries, documents, read_table

Q = S.query_ctes()


# --- A: sources -------------------------------------------------------------
@register("a1_documents", """
SELECT doc_id, text, source, n_chars, md5(text) AS fingerprint FROM documents""")
def a1_documents(spark, sf):
    return documents(spark, sf).select("doc_id", "text", "source", "n_chars", C.fingerprint("text").alias("fingerprint"))


# --- B: chunking ------------------------------------------------------------
@register("b1_sentences", f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence
FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i
      FROM (SELECT doc_id, {S.sentences_sql('text')} AS s FROM documents))""")
def b1_sentences(spark, sf):
    return C.split_sentences(documents(spark, sf))


@register("b2_sentence_window", with_sql(S.nodes_ctes(3), select='SELECT node_id, doc_id, pos, text, "window" FROM nodes'))
def b2_sentence_window(spark, sf):
    return C.sentence_window_nodes(documents(spark, sf), 3)


@register("b3_token_chunks", """
WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS toks FROM documents),
st AS (SELECT doc_id, toks, unnest(generate_series(0, greatest(len(toks) - 128 - 1, 0), 384)) AS start
       FROM t WHERE len(toks) > 0),
ch AS (SELECT doc_id, start, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS pos,
              array_to_string(toks[start + 1:start + 512], ' ') AS text FROM st)
SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR) AS node_id, doc_id, pos, text FROM ch""")
def b3_token_chunks(spark, sf):
    return C.token_chunk_nodes(documents(spark, sf), 512, 128).drop("window")


@register("b4_sentence_pack", S.sentence_pack_sql(512, 128))
def b4_sentence_pack(spark, sf):
    return C.sentence_pack_nodes(documents(spark, sf), 512, 128).drop("window")


@register("b4_sentence_pack_small", S.sentence_pack_sql(64, 16))
def b4_sentence_pack_small(spark, sf):
    return C.sentence_pack_nodes(documents(spark, sf), 64, 16).drop("window")


@register("b5_chunker_choice", """
WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS toks FROM documents),
st AS (SELECT doc_id, unnest(generate_series(0, greatest(len(toks) - 32 - 1, 0), 96)) AS start
       FROM t WHERE len(toks) > 0)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_nodes FROM st GROUP BY doc_id""")
def b5_chunker_choice(spark, sf):
    cfg = DEFAULT_CFG.but(chunking={"kind": "token", "size": 128, "overlap": 32})
    return C.chunk(documents(spark, sf), cfg).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"))


@register("b7_corpus_counts", with_sql(S.nodes_ctes(3), select="""
SELECT (SELECT count(*) FROM documents) AS n_docs, count(*) AS n_nodes,
       count(DISTINCT doc_id) AS n_docs_with_nodes FROM nodes"""))
def b7_corpus_counts(spark, sf):
    docs = documents(spark, sf)
    return C.corpus_counts(docs, C.sentence_window_nodes(docs, 3))


# --- C: index ---------------------------------------------------------------
@register("c1_node_vectors", with_sql(S.index_ctes(), select=f"""
SELECT b.node_id, CAST(b.b AS INTEGER) AS bucket, round(b.w / n.nrm, 6) AS weight
FROM node_bk b JOIN node_norm n USING (node_id)"""))
def c1_node_vectors(spark, sf):
    idx = corpus_index(spark, sf)
    v = idx.vectors.select("node_id", F.posexplode("vector").alias("bucket", "weight"))
    return v.filter(F.col("weight") > 0).select("node_id", F.col("bucket").cast("int"),
                                                F.round("weight", 6).alias("weight"))


@register("c2_query_vectors", with_sql(Q, select=f"""
SELECT b.query_id, CAST(b.b AS INTEGER) AS bucket, round(b.w / n.nrm, 6) AS weight
FROM q_bk b JOIN q_norm n USING (query_id)"""))
def c2_query_vectors(spark, sf):
    qv = Embedder().embed(benchmark_queries(spark, sf), "text")
    v = qv.select("query_id", F.posexplode("vector").alias("bucket", "weight"))
    return v.filter(F.col("weight") > 0).select("query_id", F.col("bucket").cast("int"),
                                                F.round("weight", 6).alias("weight"))


@register("c3_postings", with_sql(S.index_ctes(), select="""
SELECT p.term, p.node_id, p.tf, CAST(l.dl AS INTEGER) AS dl FROM postings p JOIN node_dl l USING (node_id)"""))
def c3_postings(spark, sf):
    return corpus_index(spark, sf).postings.select("term", "node_id", "tf", "dl")


@register("c3_doc_freq", with_sql(S.index_ctes(), select="SELECT term, df FROM dfreq"))
def c3_doc_freq(spark, sf):
    return corpus_index(spark, sf).df


@register("c3_stats", with_sql(S.index_ctes(), select="SELECT n, round(avgdl, 6) AS avgdl FROM stats"))
def c3_stats(spark, sf):
    return corpus_index(spark, sf).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


_HYDE = f"""
hq_bk AS (SELECT query_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {S.HASH_DIM} AS b, count(*) AS w
          FROM q_terms GROUP BY query_id, b),
hq_norm AS (SELECT query_id, sqrt(sum(w * w)) AS nrm FROM hq_bk GROUP BY query_id),
qa AS (SELECT query_id, b, w / nrm AS u FROM q_bk JOIN q_norm USING (query_id)),
ha AS (SELECT query_id, b, w / nrm AS u FROM hq_bk JOIN hq_norm USING (query_id)),
mx_bk AS (SELECT coalesce(qa.query_id, ha.query_id) AS query_id, coalesce(qa.b, ha.b) AS b,
                 (coalesce(qa.u, 0::DOUBLE) + coalesce(ha.u, 0::DOUBLE)) / 2::DOUBLE AS w
          FROM qa FULL OUTER JOIN ha ON qa.query_id = ha.query_id AND qa.b = ha.b),
mx_norm AS (SELECT query_id, sqrt(sum(w * w)) AS nrm FROM mx_bk GROUP BY query_id)"""


@register("c4_hyde_dense", with_sql(S.index_ctes(), Q, _HYDE, S.dense_ctes(5, prefix="mx"), select="SELECT * FROM dn"))
def c4_hyde_dense(spark, sf):
    idx = corpus_index(spark, sf)
    q = benchmark_queries(spark, sf).withColumn("pseudo_doc", default_pseudo_document("text"))
    qv = hyde_vectors(q, idx.embedder, "pseudo_doc", "text", include_original=True)
    return dense_top_k(qv, idx.vectors, 5)


_WRITTEN = _HYDE.replace("FROM q_terms GROUP BY", f"""FROM (SELECT query_id, unnest({S.words_sql("array_to_string(regexp_extract_all(text, '\\S+')[1:5], ' ')")})
               AS term FROM q) GROUP BY""")


@register("c4_hyde_written", with_sql(S.index_ctes(), Q, _WRITTEN, S.dense_ctes(5, prefix="mx"), select="SELECT * FROM dn"))
def c4_hyde_written(spark, sf):
    """HyDE with a writer called through F8 (the stub writes the query's first five tokens)."""
    idx = corpus_index(spark, sf)
    q = written_pseudo_documents(benchmark_queries(spark, sf), lambda: make_first_tokens_questioner(5),
                                 Ledger.shared(spark, "hyde").complete)
    return dense_top_k(hyde_vectors(q, idx.embedder, "pseudo_doc", "text", include_original=True), idx.vectors, 5)


# --- D: retrieval -----------------------------------------------------------
@register("d1_dense_embeddings", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score
      FROM e a, e b WHERE a.vec_id <> b.vec_id)
SELECT * FROM (SELECT query_id, vec_id, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC) AS INTEGER) AS rank FROM s)
WHERE rank <= 5""")
def d1_dense_embeddings(spark, sf):
    e = read_table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = e.select("vec_id", F.col("embedding").alias("vector"))
    return dense_top_k(q, c, 5, key="query_id", id_col="vec_id", exclude_self=True)


@register("d1_dense_text", with_sql(S.index_ctes(), Q, S.dense_ctes(5), select="SELECT * FROM dn"))
def d1_dense_text(spark, sf):
    idx = corpus_index(spark, sf)
    return dense_top_k(idx.embedder.embed(benchmark_queries(spark, sf), "text"), idx.vectors, 5)


@register("d1a_dense_lsh", f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
nb AS (SELECT least({MOST_BITS}, greatest({LEAST_BITS}, ceil(log2(count(*) / {BUCKET}::DOUBLE))))::INT AS bits,
              max(len(v))::INT AS dim FROM e),
cell AS (SELECT t, b, d, ('0x' || substr(md5(t || '-' || b || '-' || d), 1, 8))::BIGINT / 4294967296::DOUBLE - 0.5::DOUBLE AS x
         FROM range({TABLES}) r(t), range({MOST_BITS}) s(b), range((SELECT dim FROM nb)) u(d) WHERE b < (SELECT bits FROM nb)),
wall AS (SELECT t, b, list(x ORDER BY d) AS w FROM cell GROUP BY t, b),
sig AS (SELECT vec_id, t, sum(CASE WHEN list_dot_product(v, w) >= 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS s
        FROM e, wall GROUP BY vec_id, t),
flip AS (SELECT 0::BIGINT AS f UNION ALL SELECT 1::BIGINT << b FROM range({MOST_BITS}) s(b) WHERE b < (SELECT bits FROM nb)),
pair AS (SELECT DISTINCT a.vec_id AS q, c.vec_id AS c
         FROM (SELECT vec_id, t, xor(s, f) AS s FROM sig, flip) a JOIN sig c ON a.t = c.t AND a.s = c.s AND a.vec_id <> c.vec_id),
sc AS (SELECT q AS query_id, c AS vec_id, round(list_cosine_similarity(x.v, y.v), 6) AS score
       FROM pair JOIN e x ON x.vec_id = q JOIN e y ON y.vec_id = c)
SELECT * FROM (SELECT query_id, vec_id, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC) AS INTEGER) AS rank FROM sc)
WHERE rank <= 5""")
def d1a_dense_lsh(spark, sf):
    e = read_table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = e.select("vec_id", F.col("embedding").alias("vector"))
    return approx_dense_top_k(q, c, 5, key="query_id", id_col="vec_id", exclude_self=True)


@register("d2_bm25", with_sql(S.index_ctes(), Q, S.bm25_ctes(12), select="SELECT * FROM bm"))
def d2_bm25(spark, sf):
    return keyword_top_k(benchmark_queries(spark, sf), corpus_index(spark, sf), 12)


_RARE = """(SELECT query_id, string_agg(term, ' ' ORDER BY term) AS text
    FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS r
          FROM (SELECT DISTINCT item_id AS query_id, unnest({words}) AS term FROM benchmark) JOIN dfreq USING (term))
    WHERE r <= 2 GROUP BY query_id)""".format(words=S.words_sql("text"))


@register("d2_bm25_selective", with_sql(S.index_ctes(), S.query_ctes(_RARE), S.bm25_ctes(12), select="SELECT * FROM bm"))
def d2_bm25_selective(spark, sf):
    """Keyword queries (the two rarest terms of each item) by the postings alone."""
    idx = corpus_index(spark, sf)
    place = Window.partitionBy("query_id").orderBy("df", "term")
    rare = query_term_idf(benchmark_queries(spark, sf), idx).withColumn("r", F.row_number().over(place)).filter("r <= 2")
    q = rare.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("text"))
    return selective_bm25_top_k(q, idx, 12)


@register("d4_minmax", with_sql(S.index_ctes(), Q, S.bm25_ctes(12), S.minmax_cte("bm", "mm"),
                                select="SELECT query_id, node_id, round(norm, 6) AS norm FROM mm"))
def d4_minmax(spark, sf):
    hits = keyword_top_k(benchmark_queries(spark, sf), corpus_index(spark, sf), 12)
    return min_max(hits).select("query_id", "node_id", F.round("norm", 6).alias("norm"))


def _fused(spark, sf, mode, alpha):
    idx = corpus_index(spark, sf)
    q = benchmark_queries(spark, sf)
    dense = dense_top_k(idx.embedder.embed(q, "text"), idx.vectors, 5)
    kw = keyword_top_k(q, idx, 12)
    return fuse(dense, kw, mode, alpha).select(
        "query_id", "node_id", "score", F.round("dense_score", 6).alias("dense_score"),
        F.round("keyword_score", 6).alias("keyword_score"), "rank")


_FUSE_SELECT = ("SELECT query_id, node_id, score, round(dense_score, 6) AS dense_score, "
                "round(keyword_score, 6) AS keyword_score, rank FROM fz")


@register("d6_fuse_and", with_sql(S.index_ctes(), Q, S.bm25_ctes(12), S.dense_ctes(5),
                                  S.fuse_ctes("dn", "bm", "AND", 0.5), select=_FUSE_SELECT))
def d6_fuse_and(spark, sf):
    return _fused(spark, sf, "AND", 0.5)


@register("d7_fuse_or", with_sql(S.index_ctes(), Q, S.bm25_ctes(12), S.dense_ctes(5),
                                 S.fuse_ctes("dn", "bm", "OR", 0.5), select=_FUSE_SELECT))
def d7_fuse_or(spark, sf):
    return _fused(spark, sf, "OR", 0.5)


@register("d8_hybrid", with_sql(S.index_ctes(), Q, S.bm25_ctes(12), S.dense_ctes(5),
                                S.fuse_ctes("dn", "bm", "OR", 0.3),
                                select="SELECT query_id, node_id, score, rank FROM fz WHERE rank <= 5"))
def d8_hybrid(spark, sf):
    idx = corpus_index(spark, sf)
    q = benchmark_queries(spark, sf)
    dense = dense_top_k(idx.embedder.embed(q, "text"), idx.vectors, 5)
    return hybrid_top_k(dense, keyword_top_k(q, idx, 12), 5, 0.3, "OR").select("query_id", "node_id", "score", "rank")
