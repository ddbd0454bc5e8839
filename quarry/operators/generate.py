"""Prompts, batch completion, synthesis modes, usage.

F8 runs a user-supplied completer over a table of prompts with
``mapInPandas``: the completer is made once per task and called once per prompt; a failing prompt yields ``response`` null, ``error``
set and zero usage (never the previous call's result). Model calls are not
idempotent: a retried task or a re-evaluated plan calls again, unless the calls
go through a ledger (``operators/ledger.py``), as those of the plans do.

Default completer (a lexical stand-in, not a language model): the sentence
of the context with the greatest number of distinct query terms, first
wins; no context sentences -> empty answer. Usage counts whitespace tokens.
"""

from __future__ import annotations

from typing import Callable, Optional

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import SENTENCE_PATTERN, WORD_PATTERN

# ---------------------------------------------------------------------------
# Prompt templates (our own wording). The oracle fills the
# same strings, so the prompts compare byte for byte.
# ---------------------------------------------------------------------------
QA_TEMPLATE = (
    "You get retrieved passages, best first, and one user question.\n"
    "[question] {query_str}\n"
    "[passages]\n{context_str}\n[end of passages]\n"
    "Quote the passage that settles the question. If none does, say that the passages do not cover it.\n"
    "[answer] "
)
QUERY_ONLY_TEMPLATE = (
    "No passages were retrieved for this question; answer it briefly.\n"
    "[question] {query_str}\n"
    "[answer] "
)
QUESTION_TEMPLATE = (
    "[passage]\n{context_str}\n[end of passage]\n"
    "List {num_questions} question(s), each on a line of its own, whose answer stands in the passage.\n"
)
PSEUDO_DOCUMENT_TEMPLATE = (
    "[question] {query_str}\n"
    "Write a short passage, as a reference work would, that answers the question.\n"
    "[passage] "
)

USAGE_FIELDS = [T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()),
                T.StructField("total_tokens", T.LongType())]


def fill_template(template: str, context: Optional[Column] = None, query: Optional[Column] = None,
                  **literals) -> Column:
    """replace exactly the placeholders. The template is split into
    literal parts and the values are concatenated between them, so a
    document containing ``{query_str}`` is never substituted twice."""
    for k, v in literals.items():
        template = template.replace("{" + k + "}", str(v))
    pieces = regex.split(r"(\{context_str\}|\{query_str\})", template)
    cols = []
    for piece in pieces:
        if piece == "{context_str}":
            cols.append(context if context is not None else F.lit(""))
        elif piece == "{query_str}":
            cols.append(query if query is not None else F.lit(""))
        elif piece:
            cols.append(F.lit(piece))
    return F.concat(*cols)


# --- default completer -------------------------------------------------------
_SENT = regex.compile(SENTENCE_PATTERN)
_WORD = regex.compile(WORD_PATTERN)
# whitespace as the JVM's \s sees it (ASCII only), so token counts agree with Spark
_SPACE_TOKEN = regex.compile(r"[^ \t\n\x0b\f\r]+")


def _sentences(text: str) -> list[str]:
    return [s for s in (m.strip(" ") for m in _SENT.findall(text or "")) if s]


def _terms(text: str) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def best_sentence(context: Optional[str], query: Optional[str]) -> str:
    q = _terms(query)
    best, best_n = "", -1
    for s in _sentences(context):
        n = len(_terms(s) & q)
        if n > best_n:
            best, best_n = s, n
    return best


def make_extractive_completer():
    """Default completer factory: fn(prompt, context, query) -> text."""
    def complete(prompt: str, context: Optional[str], query: Optional[str]) -> str:
        return best_sentence(context, query)

    return complete


def make_first_tokens_questioner(n_tokens: int = 8):
    """Stub question writer for H2: the first ``n_tokens`` whitespace tokens."""
    def complete(prompt: str, context: Optional[str], query: Optional[str]) -> str:
        return " ".join(_SPACE_TOKEN.findall(context or "")[:n_tokens])

    return complete


def _count_tokens(s: Optional[str]) -> int:
    return len(_SPACE_TOKEN.findall(s)) if s else 0


def complete(df: DataFrame, make_completer: Callable = make_extractive_completer, prompt: str = "prompt",
             context: Optional[str] = "context", query: Optional[str] = "query_text",
             model: str = "extractive-stub") -> DataFrame:
    """F8: one completion per prompt row. Adds response, error, model and usage
    columns (prompt_tokens, completion_tokens, total_tokens)."""
    fields = [T.StructField("response", T.StringType()), T.StructField("error", T.StringType()),
              T.StructField("model", T.StringType())] + USAGE_FIELDS
    schema = T.StructType(df.schema.fields + fields)
    has_ctx = context is not None and context in df.columns
    has_q = query is not None and query in df.columns

    def run(batches):
        fn = make_completer()
        for pdf in batches:
            resp, err, pt, ct = [], [], [], []
            prompts = pdf[prompt].tolist()
            ctxs = pdf[context].tolist() if has_ctx else [None] * len(pdf)
            qs = pdf[query].tolist() if has_q else [None] * len(pdf)
            for p, c, q in zip(prompts, ctxs, qs):
                try:
                    out = fn(p, c, q)
                    usage = None
                    if isinstance(out, tuple):
                        out, usage = out
                    resp.append(out)
                    err.append(None)
                    if usage:
                        pt.append(int(usage.get("prompt_tokens", 0)))
                        ct.append(int(usage.get("completion_tokens", 0)))
                    else:
                        pt.append(_count_tokens(p))
                        ct.append(_count_tokens(out))
                except Exception as e:  # one failing prompt must not sink the batch
                    resp.append(None)
                    err.append(f"{type(e).__name__}: {e}")
                    pt.append(0)
                    ct.append(0)
            out = pdf.copy()
            out["response"] = resp
            out["error"] = err
            out["model"] = model
            out["prompt_tokens"] = pd.Series(pt, dtype="int64").values
            out["completion_tokens"] = pd.Series(ct, dtype="int64").values
            out["total_tokens"] = out["prompt_tokens"] + out["completion_tokens"]
            yield out

    return df.mapInPandas(run, schema)


def usage_report(completions: DataFrame, run: Optional[str] = None) -> DataFrame:
    """usage sums per model (and run), with rollup totals."""
    df = completions.withColumn("run", F.lit(run) if run is not None else F.col("run")) \
        if run is not None or "run" not in completions.columns else completions
    if "run" not in df.columns:
        df = df.withColumn("run", F.lit("default"))
    return df.rollup("model", "run").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.count("error").alias("errors"))


def simple_summarize(contexts: DataFrame, queries: DataFrame, make_completer: Callable = make_extractive_completer,
                     template: str = QA_TEMPLATE, key: str = "query_id", call: Callable = complete) -> DataFrame:
    """all (budgeted) context in one prompt, one call per query. ``call``: ``complete``, or
    that of a ledger (``operators/ledger.py``)."""
    j = queries.select(key, F.col("text").alias("query_text")).join(contexts, key, "left")
    j = j.withColumn("context", F.coalesce("context", F.lit("")))
    j = j.withColumn("prompt", fill_template(template, F.col("context"), F.col("query_text")))
    return call(j, make_completer)


def generation_only(queries: DataFrame, make_completer: Callable = make_extractive_completer,
                    template: str = QUERY_ONLY_TEMPLATE, key: str = "query_id", call: Callable = complete) -> DataFrame:
    """no retrieval; the query-only template."""
    j = queries.select(key, F.col("text").alias("query_text")).withColumn("context", F.lit(None).cast("string"))
    j = j.withColumn("prompt", fill_template(template, None, F.col("query_text")))
    return call(j, make_completer)


def written_pseudo_documents(queries: DataFrame, make_writer: Callable, call: Callable = complete,
                             text: str = "text") -> DataFrame:
    """C4: the queries with ``pseudo_doc``, a hypothetical answer written by the completer (F8).
    A query whose writer fails, or writes nothing, stands for its own document."""
    asked = queries.withColumn("prompt", fill_template(PSEUDO_DOCUMENT_TEMPLATE, None, F.col(text)))
    done = call(asked, make_writer, "prompt", text, text)
    written = F.when(F.length(F.trim("response")) > 0, F.col("response"))
    return done.withColumn("pseudo_doc", F.coalesce(written, F.col(text))).select(*queries.columns, "pseudo_doc")


def tree_levels(k: int, fan_in: int) -> int:
    """Number of summarise rounds for k leaves: ceil(log_fan_in(k)), at least 1."""
    levels, width = 0, max(k, 1)
    while True:
        levels += 1
        width = -(-width // fan_in)
        if width <= 1:
            return levels


def tree_summarize(packed: DataFrame, queries: DataFrame, k: int, fan_in: int = 2,
                   make_completer: Callable = make_extractive_completer, template: str = QA_TEMPLATE,
                   key: str = "query_id", ord_col: str = "ord", text: str = "text",
                   call: Callable = complete) -> DataFrame:
    """pack ``fan_in`` texts per prompt, answer, repeat on the answers.

    The number of rounds is fixed from k and fan_in before the plan runs
    (no data-dependent loop). Every round is a groupBy on (query, group).
    A failed prompt makes the answers above it null, with the first error of
    the group; the usage of all prompts below an answer is added up.
    With a ledger's ``call`` each round's completions are written before the next one reads them.
    """
    q = queries.select(key, F.col("text").alias("query_text"))
    usage = [f.name for f in USAGE_FIELDS]
    level = packed.select(key, F.col(ord_col).alias("_o"), F.col(text).alias("_t"),
                          F.lit(None).cast("string").alias("_e"), *[F.lit(0).cast("long").alias(f"_{u}") for u in usage])
    for _ in range(tree_levels(k, fan_in)):
        grp = F.floor((F.col("_o") - 1) / fan_in)
        parts = F.sort_array(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_t").alias("t"))))
        g = level.groupBy(key, grp.alias("_g")).agg(
            F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"),
            F.min_by("_e", F.when(F.col("_e").isNotNull(), F.col("_o"))).alias("_below"),
            *[F.sum(f"_{u}").alias(f"_{u}") for u in usage])
        g = g.join(q, key).withColumn("prompt", fill_template(template, F.col("context"), F.col("query_text")))
        done = call(g, make_completer)
        error = F.coalesce("_below", "error")
        level = done.select(key, (F.col("_g") + 1).cast("int").alias("_o"),
                            F.when(error.isNull(), F.col("response")).alias("_t"), error.alias("_e"),
                            *[(F.col(f"_{u}") + F.col(u)).alias(f"_{u}") for u in usage])
    return level.select(key, F.col("_t").alias("response"), F.col("_e").alias("error"),
                        *[F.col(f"_{u}").alias(u) for u in usage])
