"""Ranking helpers shared by every top-k operator.

Contract: scores are rounded to 6 decimals before ranking, order is
``score desc, id asc``, ranks start at 1.

``top_k`` is written as ``row_number() <= k`` over a window. Spark plans this
as WindowGroupLimit twice: a *partial* limit in every map task before the
shuffle on the group key, and a final one after it. So a group that holds a
third of all candidates still ships at most k rows per map task into the task
that owns the group -- the hot group is cut down before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import SCORE_DECIMALS


def round_score(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), SCORE_DECIMALS)


def rank_window(group_cols, order_cols):
    return Window.partitionBy(*group_cols).orderBy(*order_cols)


def top_k(df: DataFrame, group_cols, k: int, score: str = "score", id_col: str = "node_id",
          rank_col: str = "rank", extra_order=None) -> DataFrame:
    """Keep the ``k`` best rows per group, ranked ``score desc, [extra], id asc``."""
    order = [F.col(score).desc()] + list(extra_order or []) + [F.col(id_col).asc()]
    w = rank_window(group_cols, order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def rank_all(df: DataFrame, group_cols, score: str = "score", id_col: str = "node_id",
             rank_col: str = "rank") -> DataFrame:
    w = rank_window(group_cols, [F.col(score).desc(), F.col(id_col).asc()])
    return df.withColumn(rank_col, F.row_number().over(w))
