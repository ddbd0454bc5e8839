"""streamed deltas and chat messages.

F9 running text: the text at ``seq`` is the concatenation of every delta up to and including
it. One stream may hold a third of all rows, so no step has a stream as its key: rows are
sorted into range partitions by (stream, seq), wherever the cuts fall, and a running sum of
lengths inside a partition plus the totals of the partitions before it gives each delta its
offset in the stream's whole text. Cutting the offsets into blocks of ``BLOCK`` characters
gives the text in two levels: ``text_blocks`` holds each stream's text as (stream, block, at,
text), linear in the input, and ``running_offsets`` names for every row where its text ends.
``running_text`` writes the text out for every row, which is quadratic in a stream by its
contract: each row is joined with the blocks before its end, and its text put together.

Order and nulls: a null stream is a stream of its own; within a stream rows are ordered by
seq, null first, and rows of equal seq by their delta; a null delta is empty. Rows of equal
(stream, seq, delta) are rows of their own.

F10 message records: a message with any null field is dropped; order by
turn. The records stay one row per message: no conversation is ever
collected into a single row or task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import settle

BLOCK = 4096


def running_offsets(df: DataFrame, stream: str = "conv_id", seq: str = "turn", delta: str = "text") -> DataFrame:
    """(stream, seq, delta, start, end): where each row's delta stands in its stream's text, in characters."""
    rows = df.select(F.col(stream).alias("stream"), F.col(seq).alias("seq"), F.coalesce(F.col(delta), F.lit("")).alias("delta"))
    # settled, as the cuts are drawn from samples and every step below has to see the same ones
    order = ["stream", "seq", "delta"]
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "running")
    size = F.length("delta")
    # one row for each (partition, stream): the streams that end in a partition, and the one that goes on
    totals = placed.groupBy("part", "stream").agg(F.sum(size).alias("size"))
    crossing = totals.groupBy("stream").agg(F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    pieces = totals.join(crossing.withColumnRenamed("stream", "_s"), F.col("stream").eqNullSafe(F.col("_s")), "left_semi")
    # at most one row for each partition and stream that crosses a cut: two windows' worth of a partition count
    before = Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(F.col("part").alias("_p"), F.col("stream").alias("_s"),
                            F.coalesce(F.sum("size").over(before), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("part", "stream").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumn("_end", F.sum(size).over(inside))
    met = run.join(carried, (F.col("part") == F.col("_p")) & F.col("stream").eqNullSafe(F.col("_s")), "left")
    end = F.col("_end") + F.coalesce("carried", F.lit(0))
    return met.select("stream", "seq", "delta", "at", (end - size).alias("start"), end.alias("end"))


def text_blocks(offsets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stream, block, text): each stream's whole text in blocks of ``block`` characters."""
    cut = offsets.filter("end > start").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("end"), (F.col("block") + 1) * block)
    piece = F.substring("delta", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    # a block holds at most ``block`` characters, so at most as many pieces
    parts = F.sort_array(F.collect_list(F.struct(low.alias("low"), piece.alias("piece"))))
    return cut.groupBy("stream", "block").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))


def running_text(df: DataFrame, stream: str = "conv_id", seq: str = "turn", delta: str = "text",
                 out: str = "text_so_far", block: int = BLOCK) -> DataFrame:
    """F9 written out: (stream, seq, out) for every row of ``df``."""
    offsets = settle(running_offsets(df, stream, seq, delta), "offsets")
    blocks = settle(text_blocks(offsets, block).withColumnRenamed("stream", "_s").withColumnRenamed("block", "_b"), "blocks")
    # a row's text is the blocks up to its end, the last one cut
    rows = offsets.select("stream", "seq", "at", "end", F.explode(F.when(F.col("end") > 0, F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("end") - 1) / block))).otherwise(F.array(F.lit(-1).cast("long")))).alias("b"))
    met = rows.join(blocks, (F.col("b") == F.col("_b")) & F.col("stream").eqNullSafe(F.col("_s")), "left")
    piece = F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.least(F.col("end") - F.col("b") * block, F.lit(block)).cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("b", piece.alias("piece"))))
    return met.groupBy("stream", "seq", "at").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias(out)) \
        .select(F.col("stream").alias(stream), F.col("seq").alias(seq), out)


def message_records(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """(conv_id, turn, role, content) with null-free messages only."""
    keep = F.col(conv).isNotNull() & F.col(turn).isNotNull() & F.col(role).isNotNull() & F.col(text).isNotNull()
    return conversations.filter(keep).select(conv, turn, role, F.col(text).alias("content"))
