"""Registered queries: training data and evaluation (H, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.checks import duckdb_sql as S
from quarry.operators import chunk as C
from quarry.operators.dataset import (global_index, positional_split, qa_tables, synthetic_questions,
                                      training_mix, training_triples)
from quarry.operators.dense import dense_top_k
from quarry.operators.evaluate import compare_runs, hit_rate, hit_rows, ir_metrics, text_qrels
from quarry.operators.fuse import hybrid_top_k
from quarry.operators.sparse import keyword_top_k
from quarry.plans.registry import DEFAULT_CFG, corpus_index, register, with_sql
from quarry.session import settle
from quarry.sources.tables import benchmark_queries, documents, read_table

DOC_CFG = DEFAULT_CFG.but(chunking={"kind": "document"})
Q = S.query_ctes()

B3_NODES = """
b3_t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS toks FROM documents),
b3_st AS (SELECT doc_id, toks, unnest(generate_series(0, greatest(len(toks) - 128 - 1, 0), 384)) AS start
          FROM b3_t WHERE len(toks) > 0),
b3 AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS pos,
              array_to_string(toks[start + 1:start + 512], ' ') AS text FROM b3_st),
b3n AS (SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR) AS node_id, doc_id, pos, text,
               CAST(row_number() OVER (ORDER BY doc_id, pos) - 1 AS BIGINT) AS g FROM b3)"""


def _b3(spark, sf):
    return C.token_chunk_nodes(documents(spark, sf), 512, 128)


# --- H: training data ---------------------------------------------------------
@register("h1_split", with_sql(B3_NODES, select="""
SELECT node_id, g, CASE WHEN g < floor(2 * (SELECT count(*) FROM b3n) / 3) THEN 'train' ELSE 'val' END AS split
FROM b3n WHERE g <> floor(2 * (SELECT count(*) FROM b3n) / 3)"""))
def h1_split(spark, sf):
    return positional_split(_b3(spark, sf)).select("node_id", "g", "split")


QUESTIONS = B3_NODES + """,
qs AS (SELECT node_id || '-q0' AS query_id, node_id, array_to_string(regexp_extract_all(text, '\\S+')[1:8], ' ') AS text
       FROM b3n WHERE len(regexp_extract_all(text, '\\S+')) > 0)"""


@register("h2_questions", with_sql(QUESTIONS, select="SELECT query_id, node_id, text FROM qs"))
def h2_questions(spark, sf):
    return synthetic_questions(_b3(spark, sf))


@register("h3_qrels", with_sql(QUESTIONS, select="""
SELECT query_id, node_id, 0 AS ord FROM qs WHERE node_id IN (SELECT node_id FROM b3n)"""))
def h3_qrels(spark, sf):
    nodes = _b3(spark, sf)
    corpus, queries, qrels = qa_tables(synthetic_questions(nodes), nodes)
    # referential check: keep only judgements whose node is in the corpus
    return qrels.join(corpus.select("node_id"), "node_id", "left_semi")


@register("h6_training_mix", with_sql(QUESTIONS, """
pick AS (SELECT q.query_id, q.node_id, n.g AS r,
                ('0x' || substr(md5(q.query_id), 1, 8))::BIGINT % ((SELECT count(*) FROM b3n) - 1) AS j0
         FROM qs q JOIN b3n n USING (node_id))""", select="""
SELECT p.query_id, p.node_id AS relevant_node_id, n.node_id AS random_node_id
FROM pick p JOIN b3n n ON n.g = CASE WHEN p.j0 >= p.r THEN p.j0 + 1 ELSE p.j0 END"""))
def h6_training_mix(spark, sf):
    nodes = _b3(spark, sf)
    _, _, qrels = qa_tables(synthetic_questions(nodes), nodes)
    return training_mix(qrels, global_index(nodes))


EMB_KNN = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score
      FROM e a, e b WHERE a.vec_id <> b.vec_id),
knn AS (SELECT * FROM (SELECT query_id, vec_id, score,
          CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC) AS INTEGER) AS rank FROM s)
        WHERE rank <= {k}),
lab AS (SELECT label, min(vec_id) AS m1, min(vec_id) FILTER (WHERE vec_id > (SELECT min(vec_id) FROM embeddings x
        WHERE x.label = embeddings.label)) AS m2 FROM embeddings GROUP BY label),
exp AS (SELECT e.vec_id AS query_id, CASE WHEN e.vec_id = l.m1 THEN l.m2 ELSE l.m1 END AS expected
        FROM e JOIN lab l USING (label))"""


def _emb_knn(spark, sf, k):
    e = read_table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = e.select("vec_id", F.col("embedding").alias("vector"))
    return e, dense_top_k(q, c, k, key="query_id", id_col="vec_id", exclude_self=True)


def _emb_expected(e):
    """First relevant id per query = smallest other vec_id with the same label
    (min and second min per label: no within-label pairs are formed)."""
    lab = e.groupBy("label").agg(F.min("vec_id").alias("_m1"))
    second = e.join(lab, "label").filter(F.col("vec_id") > F.col("_m1")).groupBy("label") \
        .agg(F.min("vec_id").alias("_m2"))
    j = e.select("vec_id", "label").join(lab, "label").join(second, "label", "left")
    return j.select(F.col("vec_id").alias("query_id"),
                    F.when(F.col("vec_id") == F.col("_m1"), F.col("_m2")).otherwise(F.col("_m1")).alias("expected"))


@register("h4_triples", with_sql(EMB_KNN.format(k=10), """
neg AS (SELECT k.query_id, k.vec_id, k.rank FROM knn k JOIN e qe ON qe.vec_id = k.query_id
        JOIN e ce ON ce.vec_id = k.vec_id WHERE qe.label <> ce.label),
negr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, vec_id) AS INTEGER) AS neg_rank FROM neg)""",
                                 select="""
SELECT n.query_id, x.expected AS positive, n.vec_id AS negative, n.neg_rank FROM negr n JOIN exp x USING (query_id)
WHERE n.neg_rank <= 3 AND x.expected IS NOT NULL"""))
def h4_triples(spark, sf):
    e, hits = _emb_knn(spark, sf, 10)
    hits = settle(hits, "neighbours")  # read twice below
    labels = e.select("vec_id", "label")
    flagged = hits.join(labels.withColumnRenamed("vec_id", "query_id").withColumnRenamed("label", "_ql"), "query_id") \
        .join(labels, "vec_id")
    relevant = flagged.filter(F.col("label") == F.col("_ql")).select("query_id", "vec_id")
    pos = _emb_expected(e).filter(F.col("expected").isNotNull()) \
        .select("query_id", F.col("expected").alias("vec_id"), F.lit(0).alias("ord"))
    qrels = relevant.withColumn("ord", F.lit(1)).unionByName(pos)
    return training_triples(hits, qrels, 3, key="query_id", id_col="vec_id")


# --- V: evaluation --------------------------------------------------------------
@register("v1_hits_embeddings", with_sql(EMB_KNN.format(k=5), select="""
SELECT x.query_id, coalesce(list_contains(r.ids, CAST(x.expected AS VARCHAR)), false) AS is_hit,
       coalesce(r.retrieved, '') AS retrieved, CAST(x.expected AS VARCHAR) AS expected
FROM exp x LEFT JOIN (SELECT query_id, list(CAST(vec_id AS VARCHAR) ORDER BY rank) AS ids,
                             string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS retrieved
                      FROM knn GROUP BY query_id) r USING (query_id)"""))
def v1_hits_embeddings(spark, sf):
    e, hits = _emb_knn(spark, sf, 5)
    qrels = _emb_expected(e).filter(F.col("expected").isNotNull()) \
        .select("query_id", F.col("expected").alias("vec_id"), F.lit(0).alias("ord"))
    return hit_rows(hits, e.select(F.col("vec_id").alias("query_id")), qrels, id_col="vec_id")


@register("v3_hit_rate_embeddings", with_sql(EMB_KNN.format(k=5), select="""
SELECT count(*) AS n_queries, round(avg(CASE WHEN k.vec_id IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS hit_rate
FROM exp x LEFT JOIN knn k ON k.query_id = x.query_id AND k.vec_id = x.expected WHERE x.expected IS NOT NULL"""))
def v3_hit_rate_embeddings(spark, sf):
    return hit_rate(v1_hits_embeddings(spark, sf))


DOC_NODES = """
nodes AS (SELECT CAST(doc_id AS VARCHAR) AS node_id, doc_id, 0 AS pos, text, CAST(NULL AS VARCHAR) AS "window"
          FROM documents)"""
DOC_INDEX = S.index_ctes(nodes_sql=DOC_NODES)
QRELS = """
qr AS (SELECT b.item_id AS query_id, d.doc_id,
              CAST(row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) - 1 AS INTEGER) AS ord
       FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def _hits_sql(hits: str) -> str:
    return f"""
SELECT q.query_id, coalesce(list_contains(r.ids, x.expected), false) AS is_hit, coalesce(r.retrieved, '') AS retrieved,
       x.expected
FROM q LEFT JOIN (SELECT query_id, list(node_id ORDER BY rank) AS ids, string_agg(node_id, ',' ORDER BY rank) AS retrieved
                  FROM {hits} GROUP BY query_id) r USING (query_id)
LEFT JOIN (SELECT query_id, CAST(doc_id AS VARCHAR) AS expected FROM qr WHERE ord = 0) x USING (query_id)"""


@register("v0_text_qrels", with_sql(QRELS, select="SELECT query_id, doc_id, ord FROM qr"))
def v0_text_qrels(spark, sf):
    return text_qrels(benchmark_queries(spark, sf), documents(spark, sf))


def _doc_setup(spark, sf):
    idx = corpus_index(spark, sf, DOC_CFG)
    q = benchmark_queries(spark, sf)
    qrels = text_qrels(q, documents(spark, sf)).select("query_id", F.col("doc_id").cast("string").alias("node_id"),
                                                        "ord")
    return idx, q, qrels


@register("v1_hits_text", with_sql(DOC_INDEX, Q, S.bm25_ctes(5), QRELS, select=_hits_sql("bm")))
def v1_hits_text(spark, sf):
    idx, q, qrels = _doc_setup(spark, sf)
    return hit_rows(keyword_top_k(q, idx, 5), q, qrels)


@register("v3_hit_rate_text", with_sql(DOC_INDEX, Q, S.bm25_ctes(5), QRELS, f"h AS ({_hits_sql('bm')})", select="""
SELECT count(*) AS n_queries, round(avg(CASE WHEN is_hit THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS hit_rate
FROM h WHERE expected IS NOT NULL"""))
def v3_hit_rate_text(spark, sf):
    return hit_rate(v1_hits_text(spark, sf))


V4_SQL = with_sql(DOC_INDEX, Q, S.bm25_ctes(5), QRELS, """
rel_n AS (SELECT query_id, count(*) AS nrel FROM qr GROUP BY query_id),
fl AS (SELECT b.query_id, b.rank, CASE WHEN r.doc_id IS NOT NULL THEN 1 ELSE 0 END AS rel
       FROM bm b LEFT JOIN qr r ON r.query_id = b.query_id AND CAST(r.doc_id AS VARCHAR) = b.node_id),
fl2 AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
        FROM fl),
pq AS (SELECT query_id, sum(rel) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first,
              sum(CASE WHEN rel = 1 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0.0::DOUBLE END) AS dcg,
              sum(CASE WHEN rel = 1 THEN CAST(cum AS DOUBLE) / rank ELSE 0.0::DOUBLE END) AS ap
       FROM fl2 GROUP BY query_id),
m AS (SELECT r.nrel, least(5, r.nrel) AS mm, coalesce(p.hits, 0) AS hits, p.first,
             coalesce(p.dcg, 0.0::DOUBLE) AS dcg, coalesce(p.ap, 0.0::DOUBLE) AS ap
      FROM rel_n r LEFT JOIN pq p USING (query_id)),
mq AS (SELECT CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy,
              CAST(hits AS DOUBLE) / 5.0::DOUBLE AS precision, CAST(hits AS DOUBLE) / nrel AS recall,
              coalesce(1.0::DOUBLE / first, 0.0::DOUBLE) AS mrr,
              dcg / list_sum(list_transform(range(1, mm + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS ndcg,
              ap / mm AS map FROM m)""", select="""
SELECT count(*) AS n_queries, round(avg(accuracy), 6) AS accuracy_at_5, round(avg(precision), 6) AS precision_at_5,
       round(avg(recall), 6) AS recall_at_5, round(avg(mrr), 6) AS mrr_at_5, round(avg(ndcg), 6) AS ndcg_at_5,
       round(avg(map), 6) AS map_at_5 FROM mq""")


@register("v4_ir_metrics", V4_SQL)
def v4_ir_metrics(spark, sf):
    idx, q, qrels = _doc_setup(spark, sf)
    return ir_metrics(keyword_top_k(q, idx, 5), qrels, 5)


V5_SQL = with_sql(DOC_INDEX, Q, S.bm25_ctes(5), S.bm25_ctes(12, name="bm12"), S.dense_ctes(5),
                  S.fuse_ctes("dn", "bm12", "OR", 0.3), "hy AS (SELECT * FROM fz WHERE rank <= 5)", QRELS,
                  f"hb AS ({_hits_sql('bm')})", f"hd AS ({_hits_sql('dn')})", f"hh AS ({_hits_sql('hy')})",
                  select="""
SELECT (SELECT round(avg(CASE WHEN is_hit THEN 1.0 ELSE 0.0 END::DOUBLE), 6) FROM hb WHERE expected IS NOT NULL) AS bm25,
       (SELECT round(avg(CASE WHEN is_hit THEN 1.0 ELSE 0.0 END::DOUBLE), 6) FROM hd WHERE expected IS NOT NULL) AS dense,
       (SELECT round(avg(CASE WHEN is_hit THEN 1.0 ELSE 0.0 END::DOUBLE), 6) FROM hh WHERE expected IS NOT NULL) AS hybrid,
       round((SELECT avg(CASE WHEN is_hit THEN 1.0 ELSE 0.0 END::DOUBLE) FROM hh WHERE expected IS NOT NULL)
           - (SELECT avg(CASE WHEN is_hit THEN 1.0 ELSE 0.0 END::DOUBLE) FROM hd WHERE expected IS NOT NULL), 6)
         AS hybrid_minus_dense""")


@register("v5_compare_runs", V5_SQL)
def v5_compare_runs(spark, sf):
    idx, q, qrels = _doc_setup(spark, sf)
    dense = dense_top_k(idx.embedder.embed(q, "text"), idx.vectors, 5)
    bm = keyword_top_k(q, idx, 5)
    hy = hybrid_top_k(dense, keyword_top_k(q, idx, 12), 5, 0.3, "OR")
    rates = None
    for run, hits in (("bm25", bm), ("dense", dense), ("hybrid", hy)):
        r = hit_rate(hit_rows(hits, q, qrels), None).select(F.lit(run).alias("run"), "hit_rate")
        rates = r if rates is None else rates.unionByName(r)
    out = compare_runs(rates, ["bm25", "dense", "hybrid"], "dense", "hybrid")
    return out
