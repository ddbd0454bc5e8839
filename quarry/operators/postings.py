"""C3 on disk: postings by term, in blocks that carry bounds of their scores.

A block is up to ``BLOCK`` postings of one term: its nodes (doc_ids, poss), counts (tfs) and
node lengths (dls), and over them the number of postings, the largest count and the smallest
length. BM25's share of a posting grows with the count and falls with the length, so these
two bound the score of every posting of the block, whatever the corpus' mean length has
become since. Postings stand in a term's blocks by falling share (of the length 20), so that
the first blocks hold the best and bounds are tight.

Blocks are partitioned by ``bucket = pmod(xxhash64(term), buckets)``, at least ``BUCKETS`` and
as many as the index has partitions, and sorted by term inside: a batch of queries reads the
buckets of its terms, of them first only the bounds. A common term's postings are
written by several tasks (AQE splits a large bucket), each cutting its own blocks.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import BM25_B, BM25_K1, RagConfig
from quarry.operators.chunk import node_id

BLOCK, BUCKETS, USUAL_LENGTH = 128, 64, 20.0
_LISTS = (("doc_ids", T.LongType()), ("poss", T.IntegerType()), ("tfs", T.IntegerType()), ("dls", T.IntegerType()))
#: Postings that a map task puts together by term at a time.
GATHERED = 1 << 20
#: A posting between the map tasks and the tasks that cut blocks.
POSTING = np.dtype([("doc_ids", "<i8"), ("poss", "<i4"), ("tfs", "<i4"), ("dls", "<i4")])
BLOCK_FIELDS = [("term", T.StringType()), ("block", T.LongType()), ("n", T.IntegerType()), ("max_tf", T.IntegerType()),
                ("min_dl", T.IntegerType()), *((name, T.ArrayType(t)) for name, t in _LISTS)]


def bucket_of(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(term)), F.lit(buckets)).cast("int")


def share(tf, dl, avgdl, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """BM25 of a posting without the term's idf."""
    tf = tf.cast("double")
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))


def _runs(code: np.ndarray) -> np.ndarray:
    """Where pieces of at most BLOCK equal numbers start."""
    new = np.ones(len(code), dtype=bool)
    new[1:] = code[1:] != code[:-1]
    run = np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))
    return np.flatnonzero((np.arange(len(code)) - run) % BLOCK == 0)


def _lists(starts: np.ndarray, rows: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(np.append(starts, len(rows)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows[name]))) for name, _ in _LISTS]


def _turned(starts: np.ndarray, n: int) -> np.ndarray:
    """Where each byte of n postings stands if a row (from each start to the next) holds first the first
    bytes of all its postings, then the second ones: alike bytes side by side, which shuffle compression needs."""
    number = np.int32 if n * POSTING.itemsize < 1 << 31 else np.int64
    sizes = np.diff(np.append(starts, n)).astype(number)
    row_start, row_size = np.repeat(starts.astype(number), sizes), np.repeat(sizes, sizes)
    first = row_start * number(POSTING.itemsize) + np.arange(n, dtype=number) - row_start
    return first[:, None] + row_size[:, None] * np.arange(POSTING.itemsize, dtype=number)


def _gathered(batches):
    """The batches, put together up to GATHERED postings, so that a term has few rows and full ones."""
    held, n = [], 0
    for batch in batches:
        size = len(batch.column("terms").flatten())
        if held and n + size > GATHERED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
        if size:
            held.append(batch)
            n += size
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _gather(batches):
    """Rows of the forward table -> for each term, rows of at most BLOCK postings."""
    for batch in _gathered(batches):
        sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
        coded = batch.column("terms").flatten().dictionary_encode()
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        code, node = coded.indices.to_numpy()[order], np.repeat(np.arange(batch.num_rows), sizes)[order]
        starts = _runs(code)
        rows = np.empty(len(code), POSTING)
        rows["tfs"] = batch.column("tfs").flatten().to_numpy()[order]
        for name, column in (("doc_ids", "doc_id"), ("poss", "pos"), ("dls", "dl")):
            rows[name] = batch.column(column).to_numpy(zero_copy_only=False)[node]
        turned = np.empty(rows.nbytes, np.uint8)
        turned[_turned(starts, len(rows))] = rows.view(np.uint8).reshape(len(rows), -1)
        ends = pa.array((np.append(starts, len(rows)) * POSTING.itemsize).astype(np.int32))
        data = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends.buffers()[1], pa.py_buffer(turned)])
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[starts])), data], names=["term", "data"])


def _cut(batches):
    """Rows of postings sorted by term -> block rows; a batch's last block of a term may be short."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        data = batch.column("data")
        turned = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
        sizes = pc.binary_length(data).to_numpy() // POSTING.itemsize
        rows = turned[_turned(np.cumsum(sizes) - sizes, sizes.sum())].view(POSTING).ravel()
        row = np.repeat(np.arange(batch.num_rows), sizes)
        code = batch.column("term").dictionary_encode().indices.to_numpy()[row]  # rising, as the terms do
        tf, dl = rows["tfs"], rows["dls"]
        usual = tf * (BM25_K1 + 1.0) / (tf + BM25_K1 * (1.0 - BM25_B + BM25_B * dl / USUAL_LENGTH))
        order = np.lexsort((rows["poss"], rows["doc_ids"], -usual, code))
        rows, row = rows[order], row[order]
        starts = _runs(code[order])
        at = pa.array(row[starts])
        ids = (np.int64(part) << 32) + made + np.arange(len(starts))
        made += len(starts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("term").take(at), pa.array(ids), pa.array(np.diff(np.append(starts, len(row))).astype(np.int32)),
             pa.array(np.maximum.reduceat(rows["tfs"], starts)), pa.array(np.minimum.reduceat(rows["dls"], starts)),
             *_lists(starts, rows), batch.column("bucket").take(at)],
            names=[*(n for n, _ in BLOCK_FIELDS), "bucket"])


def build_blocks(forward: DataFrame, buckets: int) -> DataFrame:
    """The block rows, with ``bucket``, of a forward table. A map task puts the postings of a term
    together first, so that neither the shuffle nor the sort handles single postings. Blocks leave a
    task in the order of bucket, term and block: its rows are sorted once, before they are cut."""
    rows = forward.select("doc_id", "pos", "dl", "terms", "tfs").mapInArrow(_gather, "term string, data binary")
    rows = rows.withColumn("bucket", bucket_of("term", buckets)).hint("rebalance", "bucket")
    schema = T.StructType([T.StructField(n, t) for n, t in (*BLOCK_FIELDS, ("bucket", T.IntegerType()))])
    return rows.sortWithinPartitions("bucket", "term", "data").mapInArrow(_cut, schema)


def block_node_id(cfg: RagConfig, doc_id: Column, pos: Column) -> Column:
    """B6 of a posting: nodes of the document chunker have the document's id."""
    return doc_id.cast("string") if cfg.chunking.kind == "document" else node_id(doc_id, pos)


def expand_blocks(blocks: DataFrame, cfg: RagConfig, live_posting: Callable[[Column, Column], Column]) -> DataFrame:
    """term, node_id, doc_id, pos, tf, dl (and other columns of the blocks but their bounds) of
    the postings that the snapshot holds: a layer's block also lists nodes replaced since."""
    other = [c for c in blocks.columns if c not in {n for n, _ in BLOCK_FIELDS} | {"bucket"}]
    rows = blocks.select("term", *other, F.explode(F.arrays_zip("doc_ids", "poss", "tfs", "dls")).alias("_p"))
    rows = rows.select("term", *other, F.col("_p.doc_ids").alias("doc_id"), F.col("_p.poss").alias("pos"),
                       F.col("_p.tfs").alias("tf"), F.col("_p.dls").alias("dl"))
    rows = rows.filter(live_posting(F.col("v"), F.col("doc_id")))
    return rows.withColumn("node_id", block_node_id(cfg, F.col("doc_id"), F.col("pos")))
