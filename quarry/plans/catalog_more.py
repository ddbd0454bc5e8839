"""Registered queries: stemming, dataset exchange, incremental and streaming
ingest, report sink, adapter and the fine-tune evaluation plan (A2-A8, D3, H5, P6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.checks import duckdb_sql as S
from quarry.operators import chunk as C
from quarry.operators.adapt import adapter_table, apply_adapter, fit_or_load
from quarry.operators.dataset import positional_split, qa_tables, synthetic_questions
from quarry.operators.dense import dense_top_k
from quarry.operators.embed import Embedder
from quarry.operators.evaluate import hit_rate, hit_rows
from quarry.operators.fetch import with_windows
from quarry.operators.sparse import keyword_top_k
from quarry.operators.ledger import Ledger
from quarry.plans import catalog_eval as EV
from quarry.plans import finetune as P6
from quarry.plans.registry import DEFAULT_CFG, corpus_index, register, with_sql
from quarry.session import settle, shared_path
from quarry.sources.index_store import indexed_documents, load_index, upsert_index
from quarry.sources.qa_json import read_qa_dataset, write_qa_dataset, write_report
from quarry.sources.tables import benchmark_queries, documents
from quarry.streaming.ingest import DOC_SCHEMA, stream_index, stream_nodes

STEM_CFG = DEFAULT_CFG.but(layout={"stemming": True})


def _stemmed(sql: str) -> str:
    plain = S.words_sql("text")
    stemmed = (f"list_transform({plain}, lambda t: CASE WHEN regexp_matches(t, 'ies$') "
               f"THEN regexp_replace(t, 'ies$', 'y') ELSE regexp_replace(t, '([^us])s$', '\\1') END)")
    return sql.replace(plain, stemmed)


@register("d3_bm25_stemmed", _stemmed(with_sql(S.index_ctes(), S.query_ctes(), S.bm25_ctes(12),
                                               select="SELECT * FROM bm")))
def d3_bm25_stemmed(spark, sf):
    return keyword_top_k(benchmark_queries(spark, sf), corpus_index(spark, sf, STEM_CFG), 12)


def _run_dir(spark, what):
    return shared_path(spark, "quarry-runs", what, uuid.uuid4().hex[:10])


#: Bytes of a JSON object of a dataset of any size, about.
QA_OBJECT_BYTES = 16 << 20


def _qa_back(spark, sf, object_bytes=None):
    """The three tables of a dataset that was written and read, as (part, id, value, ord) rows."""
    nodes = EV._b3(spark, sf)
    corpus, queries, qrels = qa_tables(synthetic_questions(nodes), nodes)
    path = write_qa_dataset(corpus, queries, qrels, _run_dir(spark, "qa"), object_bytes=object_bytes)
    corpus, queries, qrels = read_qa_dataset(spark, path)

    def rows(part, df, id_col, value, order):
        return df.select(F.lit(part).alias("part"), F.col(id_col).alias("id"), F.col(value).alias("value"),
                         order.cast("int").alias("ord"))

    return rows("corpus", corpus, "node_id", "text", F.lit(0)) \
        .unionByName(rows("queries", queries, "query_id", "text", F.lit(0))) \
        .unionByName(rows("qrels", qrels, "query_id", "node_id", F.col("ord")))


_QA_SQL = with_sql(EV.QUESTIONS, select="""
SELECT 'corpus' AS part, node_id AS id, text AS value, 0 AS ord FROM b3n
UNION ALL SELECT 'queries', query_id, text, 0 FROM qs
UNION ALL SELECT 'qrels', query_id, node_id, 0 FROM qs""")


@register("a3_qa_roundtrip", _QA_SQL)
def a3_qa_roundtrip(spark, sf):
    return _qa_back(spark, sf)


@register("a2_qa_object", _QA_SQL)
def a2_qa_object(spark, sf):
    return _qa_back(spark, sf, QA_OBJECT_BYTES)


@register("a7_stream_nodes", with_sql(S.nodes_ctes(3), select='SELECT node_id, doc_id, pos, text, "window" FROM nodes'))
def a7_stream_nodes(spark, sf):
    run = _run_dir(spark, "stream")
    return stream_nodes(spark, sf, f"{run}/out", f"{run}/checkpoint", DEFAULT_CFG) \
        .select("node_id", "doc_id", "pos", "text", "window")


@register("a8_report_csv", with_sql(EV.DOC_INDEX, S.query_ctes(), S.bm25_ctes(5), EV.QRELS,
                                    select=EV._hits_sql("bm")))
def a8_report_csv(spark, sf):
    rows = EV.v1_hits_text(spark, sf)
    path = _run_dir(spark, "report")
    write_report(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


_A6_DOCS = """documents AS (
  SELECT doc_id, CASE WHEN doc_id % 13 = 3 THEN '' WHEN doc_id % 7 = 1 THEN text || ' One more sentence.' ELSE text END AS text
  FROM main.documents WHERE doc_id % 11 <> 2)"""


_INDEX_ROWS = """
SELECT 'node' AS kind, node_id AS id, text || '|' || coalesce("window", '') AS value FROM nodes
UNION ALL SELECT 'df', term, CAST(df AS VARCHAR) FROM dfreq
UNION ALL SELECT 'postings', '', CAST(count(*) AS VARCHAR) FROM postings
UNION ALL SELECT 'n', '', CAST(n AS VARCHAR) FROM stats"""


def _index_rows(idx):
    """An index's nodes with windows, document frequencies, number of postings and of nodes."""
    rows = with_windows(idx.nodes, idx.cfg).select(F.lit("node").alias("kind"), F.col("node_id").alias("id"),
                                                   F.concat("text", F.lit("|"), F.coalesce("window", F.lit(""))).alias("value"))
    rows = rows.unionByName(idx.df.select(F.lit("df").alias("kind"), F.col("term").alias("id"),
                                          F.col("df").cast("string").alias("value")))
    rows = rows.unionByName(idx.postings.agg(F.lit("postings").alias("kind"), F.lit("").alias("id"),
                                             F.count("*").cast("string").alias("value")))
    return rows.unionByName(idx.stats.select(F.lit("n").alias("kind"), F.lit("").alias("id"),
                                             F.col("n").cast("string").alias("value")))


@register("a6_incremental", with_sql(_A6_DOCS, S.index_ctes(), select=_INDEX_ROWS))
def a6_incremental(spark, sf):
    """Build on all documents, then update to a corpus with some edited, emptied and
    removed, twice: the tables are those of the new corpus."""
    docs = documents(spark, sf)
    path = shared_path(spark, "quarry-runs", "a6", uuid.uuid4().hex[:10])
    upsert_index(spark, docs, path, DEFAULT_CFG)
    text = F.when(F.col("doc_id") % 13 == 3, "").when(
        F.col("doc_id") % 7 == 1, F.concat("text", F.lit(" One more sentence."))).otherwise(F.col("text"))
    docs = docs.withColumn("text", text).filter("doc_id % 11 <> 2")
    upsert_index(spark, docs, path, DEFAULT_CFG)
    again = upsert_index(spark, docs, path, DEFAULT_CFG)
    if any(again.values()):
        raise AssertionError(f"the second update changed the index: {again}")
    return _index_rows(load_index(spark, path, DEFAULT_CFG))


_A7_DOCS = """documents AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN text || ' One more sentence.' ELSE text END AS text FROM main.documents)"""


@register("a7_stream_index", with_sql(_A7_DOCS, S.index_ctes(), select=_INDEX_ROWS))
def a7_stream_index(spark, sf):
    """Documents arrive in a file and some again in a later one, changed or as they were; the
    stream is stopped in between. The index is that of the last version of every document."""
    run = _run_dir(spark, "stream-index")
    docs = documents(spark, sf)
    cfg = DEFAULT_CFG.but(layout={"partitions": 4})
    columns = [f.name for f in DOC_SCHEMA]
    again = docs.filter("doc_id % 7 = 1 OR doc_id % 5 = 2").withColumn(
        "text", F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit(" One more sentence."))).otherwise(F.col("text")))
    for arrival in (docs, again):
        arrival.select(*columns).write.mode("append").parquet(f"{run}/in")
        idx = stream_index(spark, f"{run}/in", f"{run}/index", f"{run}/checkpoint", cfg)
    return _index_rows(idx)


@register("a6_incremental_rerun")
def a6_incremental_rerun(spark, sf):
    """Build the index, then run the update again: nothing changes."""
    docs = documents(spark, sf)
    path = shared_path(spark, "quarry-runs", "a6", uuid.uuid4().hex[:10])
    first = upsert_index(spark, docs, path, DEFAULT_CFG)
    second = upsert_index(spark, docs, path, DEFAULT_CFG)
    return spark.createDataFrame([("first", first["changed"], first["removed"], first["touched_parts"]),
                                  ("second", second["changed"], second["removed"], second["touched_parts"])],
                                 "run string, changed long, removed long, touched_parts long")


def _p6_parts(spark, sf):
    """B3 nodes -> H1 split -> H2 questions; vectors for questions and nodes."""
    # written once each: the chunks are read four times below, their split twice
    nodes = settle(EV._b3(spark, sf).select("node_id", "doc_id", "pos", "text"), "chunks")
    split = settle(positional_split(nodes).select("node_id", "doc_id", "pos", "text", "split"), "split")
    emb = Embedder()
    qs = synthetic_questions(split.select("node_id", "text"))
    qv = emb.embed(qs, "text").select("query_id", "node_id", F.col("vector").alias("x"))
    nv = emb.embed(split, "text").select("node_id", "split", F.col("vector").alias("y"))
    return split, qs, qv, nv


@register("h5_adapter")
def h5_adapter(spark, sf):
    split, qs, qv, nv = _p6_parts(spark, sf)
    pairs = qv.join(nv.filter(F.col("split") == "train"), "node_id")
    w = fit_or_load(spark, pairs, Embedder().dim, _run_dir(spark, "adapter"), force=True)
    return adapter_table(w, spark)


@register("p6_finetune_eval")
def p6_finetune_eval(spark, sf):
    """Fit the adapter on train pairs; hit rate at 5 on validation, base vs adapted."""
    split, qs, qv, nv = _p6_parts(spark, sf)
    qv, nv = settle(qv, "question-vectors"), settle(nv, "chunk-vectors")  # read for the fit and for both runs
    train = qv.join(nv.filter(F.col("split") == "train"), "node_id")
    w = fit_or_load(spark, train, Embedder().dim, _run_dir(spark, "adapter"), force=True)
    val_nodes = nv.filter(F.col("split") == "val").select("node_id", F.col("y").alias("vector"))
    val_q = qv.join(val_nodes.select("node_id"), "node_id")
    qrels = val_q.select("query_id", "node_id", F.lit(0).alias("ord"))
    base_q = val_q.select("query_id", F.col("x").alias("vector"))
    adapted_q = settle(apply_adapter(base_q, w), "adapted")
    out = None
    for run, q in (("base", base_q), ("adapted", adapted_q)):
        hits = dense_top_k(q, val_nodes, 5)
        r = hit_rate(hit_rows(hits, q.select("query_id"), qrels)).select(F.lit(run).alias("run"), "n_queries",
                                                                          "hit_rate")
        out = r if out is None else out.unionByName(r)
    return out


# --- P6 over datasets on disk -----------------------------------------------------
_B4 = f"""
b4 AS ({S.sentence_pack_sql(512, 128)}),
b4g AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS g FROM b4),
b4s AS (SELECT *, CASE WHEN g < floor(2 * (SELECT count(*) FROM b4) / 3) THEN 'train' ELSE 'val' END AS split
        FROM b4g WHERE g <> floor(2 * (SELECT count(*) FROM b4) / 3)),
b4q AS (SELECT node_id || '-q0' AS query_id, node_id, split, array_to_string(regexp_extract_all(text, '\\S+')[1:8], ' ') AS text
        FROM b4s WHERE len(regexp_extract_all(text, '\\S+')) > 0)"""


def _searched(split: str) -> list[str]:
    nodes = f"""nodes AS (SELECT node_id, doc_id, pos, text, CAST(NULL AS VARCHAR) AS "window" FROM b4s WHERE split = '{split}')"""
    return [_B4, S.index_ctes(nodes_sql=nodes), S.query_ctes(f"(SELECT query_id, text FROM b4q WHERE split = '{split}')"),
            S.dense_ctes(5)]


def _p6_datasets(spark, sf):
    nodes, _ = P6.load_corpus(documents(spark, sf), DEFAULT_CFG)
    return P6.prepare(nodes, _run_dir(spark, "p6"), call=Ledger.shared(spark, "questions").complete)


@register("p6_corpus_counts", with_sql(_B4, select="""
SELECT (SELECT count(*) FROM documents) AS n_docs, count(*) AS n_nodes, count(DISTINCT doc_id) AS n_docs_with_nodes FROM b4"""))
def p6_corpus_counts(spark, sf):
    return P6.load_corpus(documents(spark, sf), DEFAULT_CFG)[1]


@register("p6_triples", with_sql(*_searched("train"), """
neg AS (SELECT d.query_id, d.node_id, CAST(row_number() OVER (PARTITION BY d.query_id ORDER BY d.rank, d.node_id) AS INTEGER) AS neg_rank
        FROM dn d JOIN b4q r USING (query_id) WHERE d.node_id <> r.node_id)""", select="""
SELECT n.query_id, r.node_id AS positive, n.node_id AS negative, n.neg_rank FROM neg n JOIN b4q r USING (query_id)
WHERE n.neg_rank <= 3"""))
def p6_triples(spark, sf):
    """B4, H1, H2, H3, A3, A2, D1, H4 on the training split."""
    return P6.triples(spark, _p6_datasets(spark, sf)["train"], Embedder())


@register("v1_dataset_hits", with_sql(*_searched("val"), select="""
SELECT x.query_id, coalesce(list_contains(r.ids, x.node_id), false) AS is_hit, coalesce(r.retrieved, '') AS retrieved,
       x.node_id AS expected
FROM b4q x LEFT JOIN (SELECT query_id, list(node_id ORDER BY rank) AS ids, string_agg(node_id, ',' ORDER BY rank) AS retrieved
                      FROM dn GROUP BY query_id) r USING (query_id)
WHERE x.split = 'val'"""))
def v1_dataset_hits(spark, sf):
    """evaluate(dataset, embedder, k) of the validation dataset, read from disk: its rows."""
    return P6.evaluate(spark, _p6_datasets(spark, sf)["val"], Embedder(), 5)[0]


@register("p6_report")
def p6_report(spark, sf):
    return P6.report(spark, documents(spark, sf), _run_dir(spark, "p6"), DEFAULT_CFG, call=Ledger.shared(spark, "questions").complete)


# --- A4, A5, C5: an index written, then loaded ----------------------------------------
@register("a4_a5_persisted", with_sql(S.index_ctes(), """
terms AS (SELECT node_id, string_agg(term || ':' || CAST(tf AS VARCHAR), ' ' ORDER BY term) AS v FROM postings GROUP BY node_id)""",
                                      select="""
SELECT 'node' AS kind, node_id AS id, text AS value FROM nodes
UNION ALL SELECT 'forward', node_id, coalesce(v, '') || '|' || CAST(dl AS VARCHAR) FROM node_dl LEFT JOIN terms USING (node_id)
UNION ALL SELECT 'vector', node_id, CAST(count(*) AS VARCHAR) FROM node_bk GROUP BY node_id
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), md5(text) FROM documents"""))
def a4_a5_persisted(spark, sf):
    """The tables of an index as a later reader finds them."""
    path = shared_path(spark, "quarry-runs", "a4", uuid.uuid4().hex[:10])
    upsert_index(spark, documents(spark, sf), path, DEFAULT_CFG)
    idx = load_index(spark, path, DEFAULT_CFG)

    def rows(df, kind, key, value):
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), value.alias("value"))

    pairs = F.transform(F.arrays_zip("terms", "tfs"), lambda p: F.concat(p["terms"], F.lit(":"), p["tfs"].cast("string")))
    out = rows(idx.nodes, "node", "node_id", F.col("text"))
    out = out.unionByName(rows(idx.forward, "forward", "node_id",
                               F.concat(F.array_join(pairs, " "), F.lit("|"), F.col("dl").cast("string"))))
    nonzero = F.size(F.filter("vector", lambda x: x > 0)).cast("string")
    out = out.unionByName(rows(idx.vectors.filter("vector IS NOT NULL"), "vector", "node_id", nonzero))
    return out.unionByName(rows(indexed_documents(spark, path), "document", "doc_id", F.col("fingerprint")))


@register("c5_both_halves", with_sql(S.index_ctes(), select="""
SELECT l.node_id, CAST(l.dl AS INTEGER) AS dl, CAST(p.n AS INTEGER) AS n_terms, CAST(b.n AS INTEGER) AS n_buckets
FROM node_dl l JOIN (SELECT node_id, count(*) AS n FROM postings GROUP BY node_id) p USING (node_id)
JOIN (SELECT node_id, count(*) AS n FROM node_bk GROUP BY node_id) b USING (node_id)"""))
def c5_both_halves(spark, sf):
    """For each node with tokens: what the keyword half and the dense half hold of it."""
    idx = corpus_index(spark, sf)
    keyword = idx.postings.groupBy("node_id").agg(F.max("dl").alias("dl"), F.count("*").cast("int").alias("n_terms"))
    dense = idx.vectors.select("node_id", F.size(F.filter("vector", lambda x: x > 0)).alias("n_buckets"))
    return keyword.join(dense, "node_id").select("node_id", "dl", "n_terms", "n_buckets")
