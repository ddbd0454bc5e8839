"""Late materialisation: the text and window of retrieved nodes, in one pruned scan.

Retrieval carries node ids only. A node id names its document and position, and the document
names the partition that holds it, so the nodes around the hits are fetched by an equi-join
on (part, doc_id, pos): the planner prunes the node table's partitions to those of the hits
while it runs (dynamic partition pruning), and windows are put together from the fetched
neighbours instead of being stored with every sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import RagConfig
from quarry.operators.index import TextIndex
from quarry.session import settle


def node_places(ids: DataFrame, index: TextIndex) -> DataFrame:
    """The rows with doc_id, pos and part, read off their node_id."""
    if index.cfg.chunking.kind == "document":
        doc, pos = F.col("node_id").try_cast("long"), F.lit(0)
    else:
        last = F.substring_index("node_id", "-", -1)
        doc = F.expr("left(node_id, length(node_id) - length(substring_index(node_id, '-', -1)) - 1)").try_cast("long")
        pos = last.cast("int")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(index.parts)).cast("int")
    return ids.withColumn("doc_id", doc).withColumn("pos", pos).withColumn("part", part)


def fetch_places(places: DataFrame, index: TextIndex, at: str = "at") -> DataFrame:
    """The rows of ``places`` (doc_id, part, position ``at``, ...) with ``at_text``, the text that stands there."""
    nodes = index.nodes.select(F.col("part").alias("_part"), F.col("doc_id").alias("_doc"), F.col("pos").alias("_pos"),
                               F.col("text").alias("at_text"))
    # the filter tells the planner that the places are few, so that it prunes the nodes' partitions by them
    wanted = places.filter("part >= 0")
    met = (F.col("_part") == F.col("part")) & F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_pos") == F.col(at))
    return nodes.join(wanted, met).drop("_part", "_doc", "_pos")


def around(places: DataFrame, reach: int, at: str = "at") -> DataFrame:
    """One row for each position from ``reach`` before ``pos`` to ``reach`` after it."""
    return places.withColumn(at, F.explode(F.sequence(F.greatest(F.col("pos") - reach, F.lit(0)), F.col("pos") + reach)))


def hit_nodes(hits: DataFrame, index: TextIndex) -> DataFrame:
    """(node_id, doc_id, pos, text, window) of the nodes in a hit list, each once, written: what
    reranks, replaces or cites them reads these rows and not the index."""
    windowed = index.cfg.chunking.kind == "sentence_window"
    places = node_places(hits.select("node_id").distinct(), index)
    spans = settle(around(places, index.cfg.chunking.window if windowed else 0), "spans")
    rows = fetch_places(spans, index).groupBy("node_id", "doc_id", "pos").agg(
        F.max(F.when(F.col("at") == F.col("pos"), F.col("at_text"))).alias("text"),
        F.sort_array(F.collect_list(F.struct("at", "at_text"))).alias("_w"))
    window = F.array_join(F.transform("_w", lambda x: x["at_text"]), " ") if windowed else F.lit(None).cast("string")
    return settle(rows.select("node_id", "doc_id", "pos", "text", window.alias("window")), "hit-nodes")


def with_windows(nodes: DataFrame, cfg: RagConfig) -> DataFrame:
    """A whole node table with its windows (for exports; plans fetch them for their hits)."""
    if cfg.chunking.kind != "sentence_window":
        return nodes.withColumn("window", F.lit(None).cast("string"))
    near = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(-cfg.chunking.window, cfg.chunking.window)
    return nodes.withColumn("window", F.array_join(F.collect_list("text").over(near), " "))
