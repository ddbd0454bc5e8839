"""D1 with few queries: the corpus passes through Python once, whatever the tiles, ties and nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense as D
from quarry.operators.dense import dense_top_k


def _rows(spark, n=400):
    rng = np.random.default_rng(5)
    vecs = rng.integers(-2, 3, size=(n, 3)).astype(float)
    rows = [(f"n{i}", v.tolist()) for i, v in enumerate(vecs)] + [("none", None), ("zero", [0.0] * 3), ("empty", []), (None, [1.0, 0.0, 0.0])]
    return vecs, spark.createDataFrame(rows, "vec_id string, vector array<double>")


def test_corpus_vectors_are_not_packed_first(spark):
    """One Python pass over the corpus and no join: a scan, its scores, the k best."""
    _, c = _rows(spark)
    p = dense_top_k(c.withColumnRenamed("vec_id", "query_id"), c, 4, id_col="vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in p and "MapInArrow" not in p and "Join" not in p and "BroadcastExchange" not in p


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_ties_over_many_tiles(spark, monkeypatch, k):
    """Equal scores are told apart by ids, wherever the tiles are cut; a null id comes first."""
    vecs, c = _rows(spark)
    q = c.filter("vec_id IN ('n0', 'n1', 'n2', 'none', 'zero')").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(D, "PACK", 16)
    monkeypatch.setattr(D, "QUERY_PACK", 2)
    got = {}
    for r in dense_top_k(q, c.repartition(3), k, id_col="vec_id").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    corpus = [(f"n{i}", v) for i, v in enumerate(vecs)] + [(None, np.array([1.0, 0.0, 0.0]))]
    for i in range(3):
        unit = lambda v: v / np.linalg.norm(v)
        if not vecs[i].any():
            assert f"n{i}" not in got
            continue
        want = sorted((-round(float(unit(v) @ unit(vecs[i])), 6), x is not None, x or "") for x, v in corpus if v.any())[:k]
        assert [(x, pytest.approx(-s)) for s, known, x in want] == [(x or "", s) for x, s in got[f"n{i}"]]
    assert set(got) <= {"n0", "n1", "n2"}


def test_no_queries_or_no_corpus(spark):
    _, c = _rows(spark, 10)
    q = c.withColumnRenamed("vec_id", "query_id")
    assert dense_top_k(q.filter("query_id = 'none'"), c, 3, id_col="vec_id").count() == 0
    assert dense_top_k(q, c.filter("vec_id = 'zero'"), 3, id_col="vec_id").count() == 0
    longs = spark.range(5).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    assert {r.vec_id for r in dense_top_k(longs.withColumnRenamed("vec_id", "query_id"), longs, 2, id_col="vec_id", exclude_self=True).collect()} <= set(range(5))
    with pytest.raises(Exception, match="query dimension"):
        dense_top_k(q, longs, 2, id_col="vec_id").collect()
