"""Registered queries: one per operator of the inventory, each with its
DuckDB oracle SQL where the operator is SQL-expressible.

Every query reads the fixture tables under ``sf_dir`` in full (or tables
Spark derives from them, such as the persisted index) -- no id subsets, no
samples, no row caps beyond the operator's own top-k.
"""

from __future__ import annotations

import hashlib
from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.checks import duckdb_sql as S
from quarry.config import RagConfig
from quarry.operators import chunk as C
from quarry.operators.index import TextIndex
from quarry.sources.index_store import ensure_index
from quarry.sources.tables import benchmark_queries, documents, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DEFAULT_CFG = RagConfig()


def register(name: str, sql: Optional[str] = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


_INDEX_CACHE: dict = {}


def corpus_index(spark: SparkSession, sf_dir: str, cfg: RagConfig = DEFAULT_CFG) -> TextIndex:
    """The persisted sentence-window index of ``documents`` (built once, A6)."""
    key = (spark.sparkContext.applicationId, sf_dir, cfg)
    if key not in _INDEX_CACHE:
        tag = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
        _INDEX_CACHE[key] = ensure_index(spark, documents(spark, sf_dir), f"documents-{tag}", cfg)
    return _INDEX_CACHE[key]


def with_sql(*ctes: str, select: str) -> str:
    body = ",".join(c.strip().rstrip(",") for c in ctes if c.strip())
    return f"WITH {body}\n{select}"
