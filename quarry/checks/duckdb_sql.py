"""Independent DuckDB SQL for the correctness gate.

Each function returns one SQL string over the fixture views (documents,
benchmark, embeddings, conversations, ...). The SQL is written from the
contracts in the docs, not generated from the Spark plans. Traps handled:
DuckDB numeric literals are DECIMAL (cast to DOUBLE), sums of integers are
HUGEINT and ``row_number`` is BIGINT (cast to match Spark), lists index from 1.
"""

from __future__ import annotations

from quarry.config import BM25_B, BM25_K1, HASH_DIM, SENTENCE_PATTERN, WORD_PATTERN
from quarry.operators.generate import QA_TEMPLATE, QUERY_ONLY_TEMPLATE

SENT = SENTENCE_PATTERN
WORD = WORD_PATTERN


def d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fill_sql(template: str, context_sql: str | None, query_sql: str | None) -> str:
    """Concatenate literal parts and values, mirroring the Spark fill."""
    import regex

    out = []
    for piece in regex.split(r"(\{context_str\}|\{query_str\})", template):
        if piece == "{context_str}":
            out.append(context_sql or "''")
        elif piece == "{query_str}":
            out.append(query_sql or "''")
        elif piece:
            out.append(lit(piece))
    return "(" + " || ".join(out) + ")"


def sentences_sql(col: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({col}, '{SENT}'), lambda x: trim(x)), "
            f"lambda x: length(x) > 0)")


def words_sql(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '{WORD}')"


def nodes_ctes(window: int = 3, src: str = "documents") -> str:
    """B1 + B2 + B6: sentence-window nodes."""
    return f"""
sents AS (SELECT doc_id, {sentences_sql('text')} AS s FROM {src}),
sent_idx AS (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM sents),
nodes AS (
  SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(i - 1 AS VARCHAR) AS node_id, doc_id,
         CAST(i - 1 AS INTEGER) AS pos, s[i] AS text,
         array_to_string(s[greatest(i - {window}, 1):least(i + {window}, len(s))], ' ') AS "window"
  FROM sent_idx)"""


def index_ctes(window: int = 3, src: str = "documents", nodes_sql: str | None = None) -> str:
    """C3 over the nodes CTE: postings, node lengths, df, stats, hashed vectors."""
    base = nodes_sql if nodes_sql is not None else nodes_ctes(window, src)
    return base + f""",
node_tok AS (SELECT node_id, {words_sql('text')} AS toks FROM nodes),
node_dl AS (SELECT node_id, len(toks) AS dl FROM node_tok),
postings AS (
  SELECT term, node_id, CAST(count(*) AS INTEGER) AS tf
  FROM (SELECT node_id, unnest(toks) AS term FROM node_tok) GROUP BY term, node_id),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM node_dl WHERE dl > 0),
dfreq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
node_bk AS (
  SELECT node_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {HASH_DIM} AS b, sum(tf) AS w
  FROM postings GROUP BY node_id, b),
node_norm AS (SELECT node_id, sqrt(sum(w * w)) AS nrm FROM node_bk GROUP BY node_id)"""


def query_ctes(src: str = "(SELECT item_id AS query_id, text FROM benchmark)", prefix: str = "q") -> str:
    """Query terms and hashed query vectors for a query table (query_id, text)."""
    return f"""
{prefix} AS {src},
{prefix}_tok AS (SELECT query_id, unnest({words_sql('text')}) AS term FROM {prefix}),
{prefix}_terms AS (SELECT DISTINCT query_id, term FROM {prefix}_tok),
{prefix}_tf AS (SELECT query_id, term, count(*) AS tf FROM {prefix}_tok GROUP BY query_id, term),
{prefix}_bk AS (
  SELECT query_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {HASH_DIM} AS b, sum(tf) AS w
  FROM {prefix}_tf GROUP BY query_id, b),
{prefix}_norm AS (SELECT query_id, sqrt(sum(w * w)) AS nrm FROM {prefix}_bk GROUP BY query_id)"""


def bm25_ctes(k: int, prefix: str = "q", name: str = "bm") -> str:
    k1, b = BM25_K1, BM25_B
    return f"""
{name}_idf AS (
  SELECT qt.query_id, qt.term,
         ln({d(1.0)} + (CAST((SELECT n FROM stats) - f.df AS DOUBLE) + {d(0.5)}) / (CAST(f.df AS DOUBLE) + {d(0.5)})) AS idf
  FROM {prefix}_terms qt JOIN dfreq f USING (term)),
{name}_all AS (
  SELECT i.query_id, p.node_id,
         round(sum(i.idf * CAST(p.tf AS DOUBLE) * {d(k1 + 1.0)} /
               (CAST(p.tf AS DOUBLE) + {d(k1)} * ({d(1.0 - b)} + {d(b)} * CAST(l.dl AS DOUBLE) / (SELECT avgdl FROM stats)))), 6) AS score
  FROM {name}_idf i JOIN postings p USING (term) JOIN node_dl l USING (node_id)
  GROUP BY i.query_id, p.node_id),
{name} AS (
  SELECT * FROM (SELECT query_id, node_id, score,
                        CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id ASC) AS INTEGER) AS rank
                 FROM {name}_all) WHERE rank <= {k})"""


def dense_ctes(k: int, prefix: str = "q", name: str = "dn") -> str:
    return f"""
{name}_all AS (
  SELECT qb.query_id, nb.node_id, round(sum(qb.w * nb.w) / (qn.nrm * nn.nrm), 6) AS score
  FROM {prefix}_bk qb JOIN node_bk nb USING (b) JOIN {prefix}_norm qn USING (query_id) JOIN node_norm nn USING (node_id)
  GROUP BY qb.query_id, nb.node_id, qn.nrm, nn.nrm),
{name} AS (
  SELECT * FROM (SELECT query_id, node_id, score,
                        CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id ASC) AS INTEGER) AS rank
                 FROM {name}_all) WHERE rank <= {k})"""


def minmax_cte(src: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT query_id, node_id,
         CASE WHEN max(score) OVER w > min(score) OVER w
              THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w)
              ELSE {d(1.0)} END AS norm
  FROM {src} WINDOW w AS (PARTITION BY query_id))"""


def fuse_ctes(dense: str, keyword: str, mode: str, alpha: float, name: str = "fz") -> str:
    join = "JOIN" if mode == "AND" else "FULL OUTER JOIN"
    return minmax_cte(dense, f"{name}_d") + "," + minmax_cte(keyword, f"{name}_k") + f""",
{name}_j AS (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.node_id, b.node_id) AS node_id,
         a.norm AS dense_score, b.norm AS keyword_score,
         round(coalesce(a.norm, {d(0.0)}) + {d(alpha)} * coalesce(b.norm, {d(0.0)}), 6) AS score
  FROM {name}_d a {join} {name}_k b ON a.query_id = b.query_id AND a.node_id = b.node_id),
{name} AS (
  SELECT query_id, node_id, score, dense_score, keyword_score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id ASC) AS INTEGER) AS rank
  FROM {name}_j)"""


def rerank_ctes(cands: str, top_n: int, prefix: str = "q", name: str = "rr", text_col: str = "text") -> str:
    """E1 default over a candidate CTE (query_id, node_id, score, rank)."""
    return f"""
{name}_idf AS (
  SELECT qt.query_id, qt.term,
         ln({d(1.0)} + (CAST((SELECT n FROM stats) - f.df AS DOUBLE) + {d(0.5)}) / (CAST(f.df AS DOUBLE) + {d(0.5)})) AS idf
  FROM {prefix}_terms qt JOIN dfreq f USING (term)),
{name}_tot AS (SELECT query_id, sum(idf) AS tot FROM {name}_idf GROUP BY query_id),
{name}_nt AS (
  SELECT DISTINCT c.query_id, c.node_id, t.term
  FROM {cands} c JOIN (SELECT node_id, unnest({words_sql(text_col)}) AS term FROM nodes) t USING (node_id)),
{name}_hit AS (
  SELECT nt.query_id, nt.node_id, sum(i.idf) AS hit
  FROM {name}_nt nt JOIN {name}_idf i ON nt.query_id = i.query_id AND nt.term = i.term
  GROUP BY nt.query_id, nt.node_id),
{name}_s AS (
  SELECT c.query_id, c.node_id, c.score, c.rank AS retrieval_rank,
         round(CASE WHEN coalesce(t.tot, 0) > 0 THEN coalesce(h.hit, {d(0.0)}) / t.tot ELSE {d(0.0)} END, 6) AS rerank_score
  FROM {cands} c LEFT JOIN {name}_hit h ON c.query_id = h.query_id AND c.node_id = h.node_id
  LEFT JOIN {name}_tot t ON c.query_id = t.query_id),
{name} AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                                 ORDER BY rerank_score DESC, retrieval_rank ASC, node_id ASC) AS INTEGER) AS rank
                 FROM {name}_s) WHERE rank <= {top_n})"""


def stub_answer_sql(context_col: str, query_col: str) -> str:
    """The default completer in SQL: first sentence with the most distinct query terms."""
    return f"""coalesce((
    SELECT s FROM (
      SELECT s, i, len(list_intersect(list_distinct({words_sql('s')}), list_distinct({words_sql(query_col)}))) AS m
      FROM (SELECT unnest({sentences_sql(context_col)}) AS s, unnest(generate_series(1, len({sentences_sql(context_col)}))) AS i)
    ) ORDER BY m DESC, i ASC LIMIT 1), '')"""


def space_count(col: str) -> str:
    return f"len(regexp_extract_all({col}, '\\S+'))"


def sentence_pack_sql(size: int, overlap: int) -> str:
    """B4 as a recursive walk over each document's sentence token counts."""
    return f"""
WITH RECURSIVE
sc AS (
  SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '\\S+'))) AS t
  FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents) WHERE len(s) > 0),
walk AS (
  SELECT doc_id, 1 AS i, 1 AS st, t[1] AS tok, CAST([] AS STRUCT(a INTEGER, b INTEGER)[]) AS spans, len(t) AS n, t
  FROM sc
  UNION ALL
  SELECT doc_id, i + 1,
         CASE WHEN fits THEN st ELSE i + 1 - bk END,
         CASE WHEN fits THEN tok + nt ELSE coalesce(list_sum(t[i - bk + 1:i]), 0) + nt END,
         CASE WHEN fits THEN spans ELSE list_append(spans, {{'a': st, 'b': i}}) END,
         n, t
  FROM (SELECT *, t[i + 1] AS nt, tok + t[i + 1] <= {size} AS fits,
               len(list_filter(range(1, i - st + 1),
                   lambda k: coalesce(list_sum(t[i - k + 1:i]), 0) <= {overlap}
                         AND coalesce(list_sum(t[i - k + 1:i]), 0) + t[i + 1] <= {size})) AS bk
        FROM walk WHERE i < n)),
done AS (SELECT w.doc_id, list_append(w.spans, {{'a': w.st, 'b': w.n}}) AS spans, sc.s
         FROM walk w JOIN sc USING (doc_id) WHERE w.i = w.n),
ch AS (SELECT doc_id, s, unnest(spans) AS sp, unnest(generate_series(0, len(spans) - 1)) AS pos FROM done)
SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR) AS node_id, doc_id, CAST(pos AS INTEGER) AS pos,
       array_to_string(s[sp.a:sp.b], ' ') AS text FROM ch"""
