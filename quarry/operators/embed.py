"""Embedding nodes and queries.

Default embedder: hashed bag of words. Tokens ``[\\p{L}\\p{N}]+`` of the
lower-cased text; bucket = first 8 hex digits of md5(term) mod dim; value =
count; divided by the L2 norm. A text without tokens has no vector (null).
Tokens come from JVM expressions; their buckets are added up (one numpy ``bincount``) by Arrow
batch; a bucket is hashed once for each distinct term that a task meets.

Real models plug in as ``make_fn() -> (np.ndarray[str] -> np.ndarray[n, d])``
through ``predict_batch_udf`` (model made once per Python worker, batches of
128 by default).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Callable, Optional

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import HASH_DIM
from quarry.functions.text import stemmed, with_term_frequencies, words

VECTOR_TYPE = T.ArrayType(T.DoubleType())
#: Terms whose buckets a task remembers.
KNOWN_TERMS = 500_000


def with_terms(df: DataFrame, text: str = "text", with_stemming: bool = False, out: str = "_ts") -> DataFrame:
    """Adds struct<terms, tfs> of the retrieval tokens of ``text``; stemming is done on distinct tokens."""
    return with_term_frequencies(df, words(text), out, with_stemming)


class _Vectors:
    """Unit vectors of rows of terms; remembers the buckets of the terms it has met."""

    def __init__(self, dim: int):
        self.dim, self.buckets = dim, {}

    def _bucket(self, term: str) -> int:
        if len(self.buckets) >= KNOWN_TERMS:
            self.buckets.clear()
        found = self.buckets[term] = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % self.dim
        return found

    def of(self, rows: pa.Array, counts: Optional[np.ndarray], stemming: bool = False) -> pa.Array:
        """``counts``: how often each term stands for its row; None: once."""
        n, dim = len(rows), self.dim
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        coded = rows.flatten().dictionary_encode()
        names = (stemmed(coded.dictionary) if stemming else coded.dictionary).to_numpy(zero_copy_only=False)
        known = map(self.buckets.get, names)
        of = np.array([self._bucket(t) if b is None else b for t, b in zip(names, known)], dtype=np.int64)
        cells = np.repeat(np.arange(n, dtype=np.int64), lengths) * dim + of[coded.indices.to_numpy()]
        dense = np.bincount(cells, weights=counts, minlength=n * dim).reshape(n, dim).astype(np.float64)
        norms = np.sqrt((dense * dense).sum(axis=1))
        some = norms > 0
        offsets = np.append(0, np.cumsum(some)).astype(np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((dense[some] / norms[some, None]).ravel()),
                                        mask=pa.array(~some))


def hashed_vector(terms_struct: Column, dim: int = HASH_DIM) -> Column:
    """Dense unit vector from a struct<terms, tfs> column (see ``with_terms``)."""
    vectors = _Vectors(dim)

    @F.arrow_udf(VECTOR_TYPE)
    def vector(terms: pa.Array, tfs: pa.Array) -> pa.Array:
        return vectors.of(terms, tfs.flatten().to_numpy())

    return vector(terms_struct["terms"], terms_struct["tfs"])


def token_vector(tokens: Column, dim: int = HASH_DIM, with_stemming: bool = False) -> Column:
    """The same vector straight from an array of tokens, which are not counted by term first."""
    vectors = _Vectors(dim)

    @F.arrow_udf(VECTOR_TYPE)
    def vector(rows: pa.Array) -> pa.Array:
        return vectors.of(rows, None, with_stemming)

    return vector(tokens)


@dataclass(frozen=True)
class Embedder:
    """Pluggable embedder. ``make_fn`` None means the hashed default."""

    dim: int = HASH_DIM
    make_fn: Optional[Callable] = None
    batch_size: int = 128
    with_stemming: bool = False
    name: str = "hashed-bow"

    def embed(self, df: DataFrame, text: str = "text", out: str = "vector") -> DataFrame:
        if self.make_fn is None:
            return df.withColumn(out, token_vector(words(text), self.dim, self.with_stemming))
        from pyspark.ml.functions import predict_batch_udf

        model = predict_batch_udf(self.make_fn, return_type=T.ArrayType(T.FloatType()),
                                  batch_size=self.batch_size)
        return df.withColumn(out, model(F.col(text)).cast(VECTOR_TYPE))


def hyde_vectors(queries: DataFrame, embedder: Embedder, pseudo_col: str = "pseudo_doc",
                 text: str = "text", include_original: bool = True, out: str = "vector") -> DataFrame:
    """C4: query vector = mean of f(query) and f(pseudo document), re-normalised;
    without ``include_original`` just f(pseudo document)."""
    with_p = embedder.embed(queries, pseudo_col, "_vp")
    if not include_original:
        return with_p.withColumnRenamed("_vp", out)
    both = embedder.embed(with_p, text, "_vq")
    mean = F.when(F.col("_vq").isNull(), F.col("_vp")).when(F.col("_vp").isNull(), F.col("_vq")).otherwise(
        F.zip_with("_vq", "_vp", lambda a, b: (a + b) / 2.0))
    norm = F.sqrt(F.aggregate(F.transform(mean, lambda x: x * x), F.lit(0.0), lambda a, b: a + b))
    unit = F.when(norm > 0, F.transform(mean, lambda x: x / norm))
    return both.withColumn(out, unit).drop("_vq", "_vp")


def default_pseudo_document(text: str = "text") -> Column:
    """Stub HyDE writer: the query's distinct word tokens, in first-seen order."""
    return F.array_join(F.array_distinct(words(text)), " ")
