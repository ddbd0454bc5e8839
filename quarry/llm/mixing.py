"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target share of the word budget: weights 5, 2, 1, repeating
over the sources in code-point order (null last), capped at ``max_repeats`` times
the source's size, the excess reshared by weight. Each source's documents are
shuffled (by a keyed hash, so reruns agree) and served in that order, as often
over as the target needs. A document's virtual finish time is the words its
source has served up to its end, divided by the source's target. Sources served
in parallel in the proportion of their targets exhaust the budget at virtual time
1, so the global order of virtual finish times is cut there: what finishes by
then is taken whole, and of the document that each source is just serving, the
words served so far.

The running sums of a source are split: words are summed by (source, hash
bucket), the bucket sums are accumulated over at most ``BUCKETS`` rows a source,
and each bucket is accumulated on its own, so no source is one task.

The cut is made in that order (``queue``): every time a document may be served is a row,
in two parts if virtual time 1 falls inside it, and the rows are sorted into ranges of
their virtual finish times. The words of the ranges are accumulated over the ranges and
inside each, and the running total is cut at the budget: the whole words of all targets.

Defined cases: a null text has size 0 and is never taken; null is a source of its
own, the last one; rows that share a doc_id are ordered by their size, so that
repeated rows are served one after the other; an empty table gives no rows;
other columns are carried along by ``mix`` unless named like the three it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD_PATTERN, partitions, prepare, write_table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BUCKETS = 4096
SEED = "mix-1"
SERVED = ("copy", "taken", "virtual_finish")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.0,
            max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> also target: one row per source, all windows run on those rows.

    Capping the sources of lowest cap per weight leaves the others a level: what the
    caps leave of the budget, by weight. The level rises with every source that is
    rightly capped and falls with every further one, so the highest one holds."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget))) \
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                    / F.sum("weight").over(rest))
    out = out.withColumn("reached", F.max("level").over(everything))
    share = F.least(F.col("cap"), F.col("reached") * F.col("weight"))
    return out.select("source", "source_size", F.when(F.col("source_size") > 0, share).otherwise(0.0).alias("target"))


def _rows(docs: DataFrame, seed: str, text_col: str, source_col: str, carry: tuple[str, ...]) -> DataFrame:
    """row (the columns to carry along), doc_id, source, size, key, bucket."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), "doc_id", F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"))
    return rows.withColumn("bucket", (F.conv(F.substring("key", 1, 6), 16, 10).cast("int") % BUCKETS))


def _plan(rows: DataFrame, weights: tuple[int, ...], budget: float, max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """The targets by source; and by source and bucket (s, b) the words ahead of the bucket, source_size, target."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    goals = targets(sizes, weights, budget, max_repeats)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).drop("bucket_size")
    plan = sums.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return goals, plan.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "ahead", "source_size", "target")


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, before (words of its source served ahead of it in a round), row."""
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("ahead") + F.col("inside")).alias("before"), "row")


def queue(placed: DataFrame, goals: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, before, copy, words, virtual_finish, total: the documents' parts in the global order of virtual
    finish times, as far as the budget goes; total is the running total of words.

    A document of some words is named by its source and the words before it. Of the one
    that virtual time 1 falls into, the part served by then is a row of its own."""
    copies = F.explode(F.sequence(F.lit(1), F.lit(max_repeats))).alias("copy")
    served = placed.filter("size > 0 AND target > 0").select("source", "before", "size", "source_size", "target", copies)
    start = F.col("source_size") * (F.col("copy") - 1) + F.col("before")
    served = served.withColumn("start", start).withColumn("end", start + F.col("size")).withColumn("goal", F.floor("target"))
    part = lambda begin, end: F.struct(F.col(begin).alias("begin"), F.col(end).alias("end"))
    parts = F.when((F.col("start") < F.col("goal")) & (F.col("goal") < F.col("end")),
                   F.array(part("start", "goal"), part("goal", "end"))).otherwise(F.array(part("start", "end")))
    order = ["virtual_finish", "copy", "source", "before"]
    parts = served.select("source", "before", "copy", "target", F.explode(parts).alias("part")) \
        .select("source", "before", "copy", (F.col("part.end") - F.col("part.begin")).alias("words"),
                (F.col("part.end") / F.col("target")).alias("virtual_finish"))
    # written: the totals of the ranges and the rows inside them must come from the same ranges
    parts = write_table(parts.repartitionByRange(partitions(placed.sparkSession), *order)
                        .withColumn("range", F.spark_partition_id()), "mix-queue")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = parts.groupBy("range").agg(F.sum("words").alias("range_words")) \
        .select("range", F.coalesce(F.sum("range_words").over(ahead), F.lit(0)).alias("ahead"))
    whole = goals.agg(F.sum(F.floor("target")).alias("budget"))
    inside = Window.partitionBy("range").orderBy(*order)
    return parts.join(F.broadcast(ranges), "range").withColumn("total", F.col("ahead") + F.sum("words").over(inside)) \
        .crossJoin(F.broadcast(whole)).filter("total <= budget").select("source", "before", "copy", "words", "virtual_finish", "total")


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.0,
             max_repeats: int = MAX_REPEATS, seed: str = SEED, text_col: str = "text",
             source_col: str = "source", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, source, size, source_size, target, before (words of its source served
    ahead of it in a round), taken (its words in the queue up to the cut), row (the
    columns to carry along). Unless texts are carried, only ids and sizes are moved."""
    prepare(docs.sparkSession)
    rows = write_table(_rows(docs, seed, text_col, source_col, carry), "mix-rows")
    goals, plan = _plan(rows, weights, budget, max_repeats)
    placed = write_table(_placed(rows, plan), "mix-places")
    taken = queue(placed, goals, max_repeats).groupBy("source", "before").agg(F.sum("words").alias("taken")) \
        .select(F.col("source").alias("s"), F.col("before").alias("b"), "taken")
    sized = placed.filter("size > 0") \
        .join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("before") == F.col("b")), "left") \
        .withColumn("taken", F.coalesce("taken", F.lit(0)))
    columns = ["doc_id", "source", "size", "source_size", "target", "before", F.col("taken").cast("long").alias("taken"), "row"]
    # rows without words share their place with others, and take nothing
    return sized.select(*columns).unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0)).select(*columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.0,
        max_repeats: int = MAX_REPEATS, seed: str = SEED, text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """The mix itself, in its global order: a row for each time a document is served, with
    the document's columns and copy (from 1), taken, virtual_finish. A text that the end
    of the budget cuts is its first words, joined by a space."""
    prepare(docs.sparkSession)
    columns = [c for c in docs.columns if c not in SERVED]
    # the queue is cut on ids and sizes alone; the texts join what it leaves, by the time of the cut
    sizes = write_table(_rows(docs, seed, text_col, source_col, ("doc_id",)), "mix-rows")
    goals, plan = _plan(sizes, weights, budget, max_repeats)
    plan = write_table(plan, "mix-plan")
    last = queue(_placed(sizes, plan), goals, max_repeats).agg(F.max("virtual_finish").alias("last"))
    last = write_table(last, "mix-cut")
    rows = _placed(_rows(docs, seed, text_col, source_col, tuple(columns)), plan).filter("size > 0 AND target > 0")
    served = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max_repeats)))) \
        .withColumn("start", F.col("source_size") * (F.col("copy") - 1) + F.col("before")) \
        .withColumn("taken", F.least(F.col("size"), F.floor("target") - F.col("start"))).filter("taken > 0") \
        .crossJoin(F.broadcast(last)).filter((F.col("start") + F.col("taken")) / F.col("target") <= F.col("last"))
    served = served.withColumn("virtual_finish", (F.col("start") + F.col("size")) / F.col("target"))
    text = F.col(f"row.`{text_col}`")
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), F.col("taken").cast("int"))
    text = F.when(F.col("taken") < F.col("size"), F.array_join(words, " ")).otherwise(text).alias(text_col)
    out = [text if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns]
    return served.select("virtual_finish", "copy", "taken", *out) \
        .repartitionByRange(partitions(docs.sparkSession), "virtual_finish", "copy", "doc_id") \
        .sortWithinPartitions("virtual_finish", "copy", "doc_id").select(*columns, *SERVED)
