"""Column expressions for text: sentences, tokens, term frequencies, stemming.

Everything here but the counting of terms (``with_term_frequencies``, over Arrow batches) is a
built-in Spark expression (regex, higher-order array functions), so it runs inside the JVM on
whatever partition holds the row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import SENTENCE_PATTERN, SPACE_TOKEN_PATTERN, WORD_PATTERN


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sentences(text) -> Column:
    """B1: ordered, trimmed, non-empty sentences of ``text`` (array<string>)."""
    parts = F.regexp_extract_all(_c(text), F.lit(SENTENCE_PATTERN), 0)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def words(text) -> Column:
    """Retrieval tokens: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_PATTERN), 0)


def space_tokens(text) -> Column:
    """Whitespace tokens, used for chunk sizes and budgets."""
    return F.regexp_extract_all(_c(text), F.lit(SPACE_TOKEN_PATTERN), 0)


def space_token_count(text) -> Column:
    return F.size(space_tokens(text))


def stem(term) -> Column:
    """D3: simplified S-stemmer (Harman 1991).

    ``ies`` -> ``y``; otherwise a final ``s`` not preceded by ``u`` or ``s`` is
    dropped. The ``eies``/``aies`` and ``es`` exceptions are left out.
    """
    t = _c(term)
    return F.when(t.rlike("ies$"), F.regexp_replace(t, "ies$", "y")).otherwise(
        F.regexp_replace(t, "([^us])s$", "$1"))


def with_term_frequencies(df: DataFrame, tokens: Column, out: str = "_ts", stemming: bool = False) -> DataFrame:
    """In-row term counting: adds ``out`` = struct<terms: array<string>, tfs: array<int>>.

    The tokens of an Arrow batch are numbered by their order, and the runs of equal (row,
    number) are a row's terms, ascending, with their counts: no explode + groupBy shuffle,
    no Python per token. With ``stemming`` the distinct tokens of a batch are stemmed first.
    """
    return df.withColumn(out, (_stem_counts if stemming else _term_counts)(tokens))


_TERMS = T.StructType([T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])


def stemmed(terms: pa.Array) -> pa.Array:
    """``stem`` of an array of tokens."""
    return pc.if_else(pc.ends_with(terms, "ies"), pc.replace_substring_regex(terms, "ies$", "y"),
                      pc.replace_substring_regex(terms, "([^us])s$", r"\1"))


def _counted(tokens: pa.Array, stemming: bool) -> pa.Array:
    n = len(tokens)
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    coded = tokens.flatten().cast(pa.string()).dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary
    if stemming:
        stems = stemmed(names).dictionary_encode()
        codes, names = stems.indices.to_numpy()[codes], stems.dictionary
    by_order = pc.sort_indices(names)  # by bytes, as Spark orders strings
    place = np.empty(len(by_order), np.int64)
    place[by_order.to_numpy()] = np.arange(len(by_order))
    rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
    width = max(len(place), 1)
    runs, counts = np.unique(rows * width + place[codes], return_counts=True)
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(runs // width, minlength=n))).astype(np.int32))
    terms = names.take(by_order).take(pa.array(runs % width))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, terms),
                                       pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))], names=["terms", "tfs"])


@F.arrow_udf(_TERMS)
def _term_counts(tokens: pa.Array) -> pa.Array:
    return _counted(tokens, False)


@F.arrow_udf(_TERMS)
def _stem_counts(tokens: pa.Array) -> pa.Array:
    return _counted(tokens, True)


def md5_int(col, digits: int = 8) -> Column:
    """First ``digits`` hex digits of md5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(_c(col).cast("string")), 1, digits), 16, 10).cast("bigint")


def hash_bucket(term, dim: int) -> Column:
    """C1 default: bucket of a term = md5-prefix integer mod ``dim``."""
    return (md5_int(term) % F.lit(dim)).cast("int")
