"""Min-max normalisation and weighted fusion of two hit lists.

Both inputs are top-k lists (at most k rows per query), so every window and
join here works on bounded groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.rank import rank_all, round_score, top_k


def min_max(hits: DataFrame, key: str = "query_id", score: str = "score", out: str = "norm") -> DataFrame:
    """(s - min) / (max - min) per query; all-equal scores -> 1.0.
    An empty list contributes no rows (no division by zero, no failure)."""
    w = Window.partitionBy(key)
    mn, mx = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn(out, F.when(mx > mn, (F.col(score) - mn) / (mx - mn)).otherwise(F.lit(1.0)))


def fuse(dense: DataFrame, keyword: DataFrame, mode: str = "AND", alpha: float = 0.5,
         key: str = "query_id", id_col: str = "node_id") -> DataFrame:
    """fused = coalesce(dense_norm, 0) + alpha * coalesce(keyword_norm, 0).

    AND (D6) keeps ids in both lists (inner join), OR (D7) ids in either
    (full outer join). Output is ranked: (key, id, score, dense_score,
    keyword_score, rank).
    """
    if mode not in ("AND", "OR"):
        raise ValueError(f"fusion mode {mode!r} is neither AND nor OR")
    d = min_max(dense, key).select(key, id_col, F.col("norm").alias("dense_score"))
    kw = min_max(keyword, key).select(key, id_col, F.col("norm").alias("keyword_score"))
    how = "inner" if mode == "AND" else "full_outer"
    j = d.join(kw, [key, id_col], how)
    fused = F.coalesce("dense_score", F.lit(0.0)) + F.lit(float(alpha)) * F.coalesce("keyword_score", F.lit(0.0))
    out = j.select(key, id_col, round_score(fused).alias("score"), "dense_score", "keyword_score")
    return rank_all(out, [key], id_col=id_col)


def hybrid_top_k(dense_hits: DataFrame, keyword_hits: DataFrame, k: int, alpha: float = 0.3,
                 mode: str = "OR", key: str = "query_id", id_col: str = "node_id") -> DataFrame:
    """Fuse the dense (top 5) and keyword (top 12) lists, keep the k best."""
    fused = fuse(dense_hits, keyword_hits, mode, alpha, key, id_col).drop("rank")
    return top_k(fused, [key], k, id_col=id_col)
