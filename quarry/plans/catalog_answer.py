"""Registered queries: postprocessing, prompts, generation, routing, plans (E, F, G, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.checks import duckdb_sql as S
from quarry.config import RagConfig
from quarry.operators.dense import dense_top_k
from quarry.operators.fetch import hit_nodes
from quarry.operators.fuse import hybrid_top_k
from quarry.operators.generate import (QA_TEMPLATE, QUERY_ONLY_TEMPLATE, complete, fill_template, generation_only,
                                       make_extractive_completer, tree_summarize, usage_report)
from quarry.operators.ledger import Ledger
from quarry.operators.messages import message_records, running_text
from quarry.operators.pack import (budget_context, build_context, compress_context, replace_with_metadata, repack,
                                   source_node, template_token_count)
from quarry.operators.rerank import rerank
from quarry.operators.route import classify_by_keyword_score, route_counts
from quarry.operators.sparse import keyword_top_k
from quarry.plans.answer import answer, routed_answer
from quarry.plans.registry import DEFAULT_CFG, corpus_index, register, with_sql
from quarry.session import settle
from quarry.sources.tables import benchmark_queries, read_table

Q = S.query_ctes()
NL2 = "chr(10) || chr(10)"


def _hybrid(spark, sf, k=5):
    idx = corpus_index(spark, sf)
    q = benchmark_queries(spark, sf)
    dense = dense_top_k(idx.embedder.embed(q, "text"), idx.vectors, 5)
    hits = hybrid_top_k(dense, keyword_top_k(q, idx, 12), k, 0.3, "OR").select("query_id", "node_id", "score", "rank")
    return idx, q, settle(hits, "hits")


def _windows(hits, idx):
    hits = settle(hits, "hits")
    return replace_with_metadata(hits, hit_nodes(hits, idx), "window")


HYBRID = [S.index_ctes(), Q, S.bm25_ctes(12), S.dense_ctes(5), S.fuse_ctes("dn", "bm", "OR", 0.3),
          "hy AS (SELECT query_id, node_id, score, rank FROM fz WHERE rank <= 5)"]
RERANKED = HYBRID + [S.rerank_ctes("hy", 2)]


# --- E: postprocessing ------------------------------------------------------
@register("e1_rerank", with_sql(*RERANKED, select="""
SELECT query_id, node_id, score, retrieval_rank, rerank_score, rank FROM rr"""))
def e1_rerank(spark, sf):
    idx, q, hits = _hybrid(spark, sf)
    return rerank(hits, q, idx, 2)


@register("e2_window_replace", with_sql(*HYBRID, select="""
SELECT h.query_id, h.node_id, h.rank, coalesce(n."window", n.text) AS text FROM hy h JOIN nodes n USING (node_id)"""))
def e2_window_replace(spark, sf):
    idx, q, hits = _hybrid(spark, sf)
    return _windows(hits.select("query_id", "node_id", "rank"), idx) \
        .select("query_id", "node_id", "rank", "text")


@register("e3_rerank_then_window", with_sql(*RERANKED, select="""
SELECT r.query_id, r.node_id, r.rank, r.rerank_score, coalesce(n."window", n.text) AS text
FROM rr r JOIN nodes n USING (node_id)"""))
def e3_rerank_then_window(spark, sf):
    idx, q, hits = _hybrid(spark, sf)
    rr = rerank(hits, q, idx, 2).select("query_id", "node_id", "rank", "rerank_score")
    return _windows(rr, idx).select("query_id", "node_id", "rank", "rerank_score", "text")


@register("e4_repack_sides", with_sql(*HYBRID, select="""
SELECT query_id, node_id, rank,
       CAST(CASE WHEN rank % 2 = 1 THEN (rank + 1) / 2
                 ELSE count(*) OVER (PARTITION BY query_id) - rank / 2 + 1 END AS INTEGER) AS ord
FROM hy"""))
def e4_repack_sides(spark, sf):
    idx, q, hits = _hybrid(spark, sf)
    return repack(hits.select("query_id", "node_id", "rank"), "sides")


@register("e4_repack_reverse", with_sql(*HYBRID, select="""
SELECT query_id, node_id, rank, CAST(count(*) OVER (PARTITION BY query_id) - rank + 1 AS INTEGER) AS ord FROM hy"""))
def e4_repack_reverse(spark, sf):
    idx, q, hits = _hybrid(spark, sf)
    return repack(hits.select("query_id", "node_id", "rank"), "reverse").withColumn("ord", F.col("ord").cast("int"))


E5_SQL = with_sql(*RERANKED, f"""
spans AS (SELECT r.query_id, r.rank AS ord, n.doc_id,
                 unnest(generate_series(greatest(n.pos - 3, 0), n.pos + 3)) AS spos
          FROM rr r JOIN nodes n USING (node_id)),
sp AS (SELECT query_id, doc_id, spos, min(ord) AS o FROM spans GROUP BY query_id, doc_id, spos),
ss AS (SELECT sp.*, n.text AS sentence FROM sp JOIN nodes n ON n.doc_id = sp.doc_id AND n.pos = sp.spos),
ss_t AS (SELECT DISTINCT query_id, doc_id, spos, unnest({S.words_sql('sentence')}) AS term FROM ss),
ss_h AS (SELECT t.query_id, t.doc_id, t.spos, sum(i.idf) AS hit
         FROM ss_t t JOIN rr_idf i ON t.query_id = i.query_id AND t.term = i.term GROUP BY ALL),
sc AS (SELECT ss.query_id, ss.doc_id, ss.spos, ss.o, ss.sentence,
              round(CASE WHEN coalesce(t.tot, 0) > 0 THEN coalesce(h.hit, 0::DOUBLE) / t.tot ELSE 0::DOUBLE END, 6) AS score
       FROM ss LEFT JOIN ss_h h USING (query_id, doc_id, spos) LEFT JOIN rr_tot t USING (query_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY score DESC, o ASC, doc_id ASC, spos ASC, CAST(doc_id AS VARCHAR) || '-' || CAST(spos AS VARCHAR) ASC) AS r
          FROM sc) WHERE r <= 3)""", select="""
SELECT query_id, doc_id, CAST(spos AS INTEGER) AS pos, sentence, score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, doc_id, spos) AS INTEGER) AS ord_in_context
FROM best""")


@register("e5_compress", E5_SQL)
def e5_compress(spark, sf):
    idx, q, hits = _hybrid(spark, sf)
    rr = rerank(hits, q, idx, 2).select("query_id", "node_id", F.col("rank").alias("ord"))
    return compress_context(rr, q, idx, 3)


@register("e6_source", with_sql(*RERANKED, select="""
SELECT r.query_id, r.node_id, n."window" AS "window", n.text AS sentence FROM rr r JOIN nodes n USING (node_id)
WHERE r.rank = 1"""))
def e6_source(spark, sf):
    idx, q, hits = _hybrid(spark, sf)
    ranked = settle(rerank(hits, q, idx, 2).select("query_id", "node_id", "rank"), "ranked")
    return source_node(ranked, hit_nodes(ranked, idx))


# --- F: prompts and generation ----------------------------------------------
def _budget_ctes(src: str, cfg: RagConfig, template: str = QA_TEMPLATE) -> str:
    """F4 + F3 over a packed CTE (query_id, node_id, ord, text)."""
    fixed = cfg.context.limit - cfg.context.reserved - template_token_count(template)
    return f"""
bud AS (SELECT p.query_id, p.node_id, p.ord, p.text, {fixed} - {S.space_count('q.text')} AS budget,
               sum({S.space_count('p.text')}) OVER (PARTITION BY p.query_id ORDER BY p.ord
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
               p.ord = min(p.ord) OVER (PARTITION BY p.query_id) AS is_first
        FROM {src} p JOIN q USING (query_id)),
kept AS (SELECT query_id, node_id, ord,
                CASE WHEN is_first AND run > budget
                     THEN array_to_string(regexp_extract_all(text, '\\S+')[1:greatest(budget, 1)], ' ')
                     ELSE text END AS text
         FROM bud WHERE run <= budget OR (is_first AND run > budget AND budget > 0)),
ctx AS (SELECT query_id, string_agg(text, {NL2} ORDER BY ord) AS context FROM kept GROUP BY query_id),
ans AS (SELECT q.query_id, q.text AS query_text, coalesce(c.context, '') AS context
        FROM q LEFT JOIN ctx c USING (query_id)),
gen AS (SELECT query_id, query_text, context, {S.fill_sql(template, 'context', 'query_text')} AS prompt,
               {S.stub_answer_sql('context', 'query_text')} AS response FROM ans)"""


def _answer_sql(hits: str, cfg: RagConfig, base) -> str:
    ctes, select = _answer_parts(hits, cfg, base)
    return with_sql(*ctes, select=select)


def _answer_parts(hits: str, cfg: RagConfig, base):
    """P1-P4 SQL: (optional rerank) -> window -> budget -> context -> prompt -> stub -> sources."""
    ctes = list(base)
    if cfg.context.keep is not None:
        ctes.append(S.rerank_ctes(hits, cfg.context.keep))
        ranked = "rr"
    else:
        ranked = hits
    ctes.append(f"""packed AS (SELECT r.query_id, r.node_id, r.rank AS ord, coalesce(n."window", n.text) AS text
                   FROM {ranked} r JOIN nodes n USING (node_id))""")
    ctes.append(_budget_ctes("packed", cfg))
    ctes.append(f"""src AS (SELECT r.query_id, r.node_id AS source_node_id, n."window" AS "window", n.text AS sentence
                FROM {ranked} r JOIN nodes n USING (node_id) WHERE r.rank = 1)""")
    return ctes, (f"""
SELECT g.query_id, g.response, CAST(NULL AS VARCHAR) AS error,
       CAST({S.space_count('g.prompt')} AS BIGINT) AS prompt_tokens,
       CAST({S.space_count('g.response')} AS BIGINT) AS completion_tokens,
       CAST({S.space_count('g.prompt')} + {S.space_count('g.response')} AS BIGINT) AS total_tokens,
       s.source_node_id, s."window", s.sentence
FROM gen g LEFT JOIN src s USING (query_id)""")


DENSE = [S.index_ctes(), Q, S.dense_ctes(5)]
P1 = DEFAULT_CFG
P2 = DEFAULT_CFG.but(context={"keep": None})
P3 = DEFAULT_CFG.but(search={"keyword": None})
P4 = DEFAULT_CFG.but(search={"keyword": None}, context={"keep": None})


def _plan(cfg):
    def run(spark, sf):
        return answer(benchmark_queries(spark, sf), corpus_index(spark, sf, DEFAULT_CFG), cfg, ledger=Ledger.shared(spark))

    return run


register("p1_hybrid_rerank", _answer_sql("hy", P1, HYBRID))(_plan(P1))
register("p2_hybrid", _answer_sql("hy", P2, HYBRID))(_plan(P2))
register("p3_dense_rerank", _answer_sql("dn", P3, DENSE))(_plan(P3))
register("p4_dense", _answer_sql("dn", P4, DENSE))(_plan(P4))
# F5 (simple summarize) is the synthesis step of P1; registered under its own id too
register("f5_simple_summarize", _answer_sql("hy", P1, HYBRID))(_plan(P1))


def _packed_spark(spark, sf):
    idx, q, hits = _hybrid(spark, sf)
    rr = rerank(hits, q, idx, 2).select("query_id", "node_id", "rank")
    packed = repack(_windows(rr, idx).select("query_id", "node_id", "rank", "text"),
                    "forward")
    return idx, q, budget_context(packed, q, P1.context.limit, P1.context.reserved, QA_TEMPLATE)


_F_BASE = RERANKED + [f"""packed AS (SELECT r.query_id, r.node_id, r.rank AS ord, coalesce(n."window", n.text) AS text
                          FROM rr r JOIN nodes n USING (node_id))""", _budget_ctes("packed", P1)]


@register("f1_prompt", with_sql(*_F_BASE, select="SELECT query_id, prompt FROM gen"))
def f1_prompt(spark, sf):
    idx, q, packed = _packed_spark(spark, sf)
    ctx = build_context(packed)
    j = q.join(ctx, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return j.select("query_id", fill_template(QA_TEMPLATE, F.col("context"), F.col("text")).alias("prompt"))


@register("f2_query_only_prompt", f"""
SELECT item_id AS query_id, {S.fill_sql(QUERY_ONLY_TEMPLATE, None, 'text')} AS prompt FROM benchmark""")
def f2_query_only_prompt(spark, sf):
    q = benchmark_queries(spark, sf)
    return q.select("query_id", fill_template(QUERY_ONLY_TEMPLATE, None, F.col("text")).alias("prompt"))


@register("f3_context", with_sql(*_F_BASE, select="SELECT query_id, context FROM ctx"))
def f3_context(spark, sf):
    idx, q, packed = _packed_spark(spark, sf)
    return build_context(packed)


_F4_CFG = DEFAULT_CFG.but(context={"limit": 400, "reserved": 100})
_F4_BASE = HYBRID + [f"""packed AS (SELECT h.query_id, h.node_id, h.rank AS ord, coalesce(n."window", n.text) AS text
                         FROM hy h JOIN nodes n USING (node_id))""", _budget_ctes("packed", _F4_CFG)]


@register("f4_budget", with_sql(*_F4_BASE, select="SELECT query_id, node_id, ord, text FROM kept"))
def f4_budget(spark, sf):
    idx, q, hits = _hybrid(spark, sf)
    packed = repack(_windows(hits.select("query_id", "node_id", "rank"), idx)
                    .select("query_id", "node_id", "rank", "text"), "forward")
    kept = budget_context(packed, q, _F4_CFG.context.limit, _F4_CFG.context.reserved, QA_TEMPLATE)
    return kept.select("query_id", "node_id", "ord", "text")


def _tree_sql(levels: int, fan_in: int) -> str:
    ctes = HYBRID + [f"""l0 AS (SELECT h.query_id, h.rank AS ord, coalesce(n."window", n.text) AS text
                        FROM hy h JOIN nodes n USING (node_id))"""]
    for i in range(1, levels + 1):
        ctes.append(f"""l{i}_g AS (SELECT query_id, floor((ord - 1) / {fan_in}) AS g,
                                      string_agg(text, {NL2} ORDER BY ord) AS context
                               FROM l{i - 1} GROUP BY query_id, g)""")
        ctes.append(f"""l{i} AS (SELECT g.query_id, CAST(g.g + 1 AS INTEGER) AS ord,
                                    {S.stub_answer_sql('g.context', 'q.text')} AS text
                             FROM l{i}_g g JOIN q USING (query_id))""")
    return with_sql(*ctes, select=f"SELECT q.query_id, l.text AS response FROM q LEFT JOIN l{levels} l USING (query_id)")


@register("f6_tree_summarize", _tree_sql(3, 2))
def f6_tree_summarize(spark, sf):
    idx, q, hits = _hybrid(spark, sf)
    packed = repack(_windows(hits.select("query_id", "node_id", "rank"), idx)
                    .select("query_id", "node_id", "rank", "text"), "forward")
    tree = tree_summarize(packed, q, 5, 2)
    return q.select("query_id").join(tree.select("query_id", "response"), "query_id", "left")


_GENERATED = f"""
SELECT item_id AS query_id, '' AS response, CAST(NULL AS VARCHAR) AS error,
       CAST({S.space_count(S.fill_sql(QUERY_ONLY_TEMPLATE, None, 'text'))} AS BIGINT) AS prompt_tokens,
       CAST(0 AS BIGINT) AS completion_tokens,
       CAST({S.space_count(S.fill_sql(QUERY_ONLY_TEMPLATE, None, 'text'))} AS BIGINT) AS total_tokens,
       CAST(NULL AS VARCHAR) AS source_node_id, CAST(NULL AS VARCHAR) AS "window", CAST(NULL AS VARCHAR) AS sentence
FROM benchmark"""


@register("p_generation", _GENERATED)
def p_generation(spark, sf):
    """Response mode "generation": the plan of P1-P4 without retrieval."""
    return answer(benchmark_queries(spark, sf), corpus_index(spark, sf), P1.but(synthesis={"mode": "generation"}))


@register("f7_generation", f"""
WITH g AS (SELECT item_id AS query_id, {S.fill_sql(QUERY_ONLY_TEMPLATE, None, 'text')} AS prompt FROM benchmark)
SELECT query_id, prompt, '' AS response, CAST({S.space_count('prompt')} AS BIGINT) AS prompt_tokens,
       CAST(0 AS BIGINT) AS completion_tokens, CAST({S.space_count('prompt')} AS BIGINT) AS total_tokens FROM g""")
def f7_generation(spark, sf):
    out = generation_only(benchmark_queries(spark, sf))
    return out.select("query_id", "prompt", "response", "prompt_tokens", "completion_tokens", "total_tokens")


_F8_SQL = f"""
WITH u AS (SELECT c.conv_id, c.turn, c.text AS query_text, coalesce(a.text, '') AS context
           FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1
             AND a.role = 'assistant'
           WHERE c.role = 'user'),
g AS (SELECT conv_id, turn, {S.fill_sql(QA_TEMPLATE, 'context', 'query_text')} AS prompt,
             {S.stub_answer_sql('context', 'query_text')} AS response FROM u)
SELECT conv_id, turn, response, CAST(NULL AS VARCHAR) AS error,
       CAST({S.space_count('prompt')} AS BIGINT) AS prompt_tokens,
       CAST({S.space_count('response')} AS BIGINT) AS completion_tokens FROM g"""


def _f8_prompts(spark, sf):
    c = read_table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query_text"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("context"))
    j = u.join(a, ["conv_id", "turn"], "left").withColumn("context", F.coalesce("context", F.lit("")))
    return j.withColumn("prompt", fill_template(QA_TEMPLATE, F.col("context"), F.col("query_text")))


@register("f8_completions", _F8_SQL)
def f8_completions(spark, sf):
    out = complete(_f8_prompts(spark, sf), make_extractive_completer)
    return out.select("conv_id", "turn", "response", "error", "prompt_tokens", "completion_tokens")


@register("f9_running_text", """
SELECT conv_id, turn, string_agg(text, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS text_so_far FROM conversations""")
def f9_running_text(spark, sf):
    c = read_table(spark, sf, "conversations")
    return running_text(c, "conv_id", "turn", "text", out="text_so_far")


@register("f10_messages", """
SELECT conv_id, turn, role, text AS content FROM conversations
WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL""")
def f10_messages(spark, sf):
    return message_records(read_table(spark, sf, "conversations"))


_F11_SQL = f"""
WITH u AS (SELECT c.conv_id, c.turn, c.text AS query_text, coalesce(a.text, '') AS context
           FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1
             AND a.role = 'assistant'
           WHERE c.role = 'user'),
g AS (SELECT {S.fill_sql(QA_TEMPLATE, 'context', 'query_text')} AS prompt,
             {S.stub_answer_sql('context', 'query_text')} AS response FROM u),
r AS (SELECT 'extractive-stub' AS model, 'conversations' AS run, CAST(NULL AS VARCHAR) AS error,
             {S.space_count('prompt')} AS prompt_tokens, {S.space_count('response')} AS completion_tokens FROM g)
SELECT model, run, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, count(error) AS errors
FROM r GROUP BY ROLLUP (model, run)"""


@register("f11_usage", _F11_SQL)
def f11_usage(spark, sf):
    out = complete(_f8_prompts(spark, sf), make_extractive_completer)
    return usage_report(out, run="conversations")


# --- G: routing ---------------------------------------------------------------
ROUTE_T = DEFAULT_CFG.synthesis.route_at
_G1 = [S.index_ctes(), Q, S.bm25_ctes(1, name="top1"),
       f"""routes AS (SELECT q.query_id, t.score AS top_score,
                        CAST(CASE WHEN t.score IS NOT NULL AND t.score >= {S.d(ROUTE_T)} THEN 0 ELSE 1 END AS INTEGER) AS route
                 FROM q LEFT JOIN top1 t USING (query_id))"""]


@register("g1_classify", with_sql(*_G1, select="SELECT query_id, top_score, route FROM routes"))
def g1_classify(spark, sf):
    return classify_by_keyword_score(benchmark_queries(spark, sf), corpus_index(spark, sf), ROUTE_T)


@register("g2_route_counts", with_sql(*_G1, select="SELECT route, count(*) AS n_queries FROM routes GROUP BY route"))
def g2_route_counts(spark, sf):
    r = classify_by_keyword_score(benchmark_queries(spark, sf), corpus_index(spark, sf), ROUTE_T)
    return route_counts(r)


def _p5_sql(*routes: str) -> str:
    # RAG branch = P1 restricted to the queries routed to 0 (each query's answer
    # depends only on the corpus, not on the other queries); direct branch = F7
    ctes, select = _answer_parts("hy", P1, HYBRID)
    ctes = ctes + list(routes or _G1[2:]) + [f"rag AS ({select})"]
    prompt = S.fill_sql(QUERY_ONLY_TEMPLATE, None, 'q.text')
    return with_sql(*ctes, select=f"""
SELECT rag.*, 0 AS route FROM rag JOIN routes r USING (query_id) WHERE r.route = 0
UNION ALL
SELECT q.query_id, '' AS response, CAST(NULL AS VARCHAR) AS error,
       CAST({S.space_count(prompt)} AS BIGINT) AS prompt_tokens, CAST(0 AS BIGINT) AS completion_tokens,
       CAST({S.space_count(prompt)} AS BIGINT) AS total_tokens,
       CAST(NULL AS VARCHAR) AS source_node_id, CAST(NULL AS VARCHAR) AS "window",
       CAST(NULL AS VARCHAR) AS sentence, 1 AS route
FROM q JOIN routes r USING (query_id) WHERE r.route = 1""")


@register("p5_routed", _p5_sql())
def p5_routed(spark, sf):
    return routed_answer(benchmark_queries(spark, sf), corpus_index(spark, sf), DEFAULT_CFG, ledger=Ledger.shared(spark))


def make_length_classifier():
    """Stub of a supplied classifier: queries of fewer than 25 whitespace tokens are answered directly."""
    return lambda texts: [int(len(t.split()) < 25) for t in texts]


@register("p5_routed_supplied", _p5_sql("routes AS (SELECT query_id, CAST(CASE WHEN "
                                        f"{S.space_count('text')} < 25 THEN 1 ELSE 0 END AS INTEGER) AS route FROM q)"))
def p5_routed_supplied(spark, sf):
    """P5 with a supplied classifier in place of the BM25 threshold."""
    return routed_answer(benchmark_queries(spark, sf), corpus_index(spark, sf), DEFAULT_CFG,
                         make_classifier=make_length_classifier, ledger=Ledger.shared(spark))
