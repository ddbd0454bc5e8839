"""Approximate nearest neighbours by collision counting (largest inner product).

Vectors get one more component that makes all norms equal, so the largest inner
product is the smallest distance. Every one of ``PROJECTIONS`` random lines is a
hash table of its own: a sorted array of the vectors' places on it. A query opens
on each line a window around its own place; a vector collides where it lies in the
window. Windows are widened step by step (virtual rehashing: the arrays stay as
they are, a step only adds the two ends of each window) until enough vectors reach
the collision threshold; all vectors that reach it are verified by their exact
inner product.

Vectors are indexed in blocks of at most ``BLOCK`` rows; each block is one row of
the index table. The stated queries, in blocks too, visit every data block, and a
task holds one data block and one query block at a time.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do those of another length than most; rows that share a query's
vec_id count as the query's own; with fewer than k candidates all are returned;
ties go to the smaller vec_id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import prepare, write_table

K, QUERY_STEP = 20, 20
PROJECTIONS, SEED = 64, 7
#: Share of the lines on which a candidate collides, and share of a block that ends the widening. Vectors
#: without any structure (the hardest case: all distances much alike) need shares like these for recall 0.9.
THRESHOLD, ENOUGH = 0.8, 0.3
#: Cells of a line and their width in units of the longest vector.
CELLS, CELL = 320, 0.035
#: A window is opened so wide that it holds this share of a block on average, then by so many cells at each end.
OPEN, STEP = 0.6, 2
BLOCK, QUERY_BLOCK = 16384, 512


def usable(table: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v: array<double>) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")) \
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual.n if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def lines(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((PROJECTIONS, dim + 1)).astype(np.float32)


def _pack(top: float, index: bool):
    """One row of a block: ids, vectors and, for the index, each line's sorted places and order."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        x = _matrix(table["v"].combine_chunks())
        out = {"block": table["block"].slice(0, 1), "n": [len(ids)], "ids": [ids.tobytes()],
               "vectors": [x.tobytes()], "starts": [b""], "orders": [b""]}
        if index:
            rest = np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0.0))
            places = lines(x.shape[1]) @ np.column_stack((x, rest)).T.astype(np.float32)
            orders = np.argsort(places, axis=1, kind="stable").astype(np.int32)
            cell = np.take_along_axis(cells(places, top), orders, axis=1)
            starts = [np.searchsorted(c, np.arange(CELLS + 1)) for c in cell]
            out["starts"] = [np.array(starts, dtype=np.int32).tobytes()]
            out["orders"] = [orders.tobytes()]
        return pa.table(out, schema=_PACKED)

    return run


_PACKED = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()),
                     ("starts", pa.binary()), ("orders", pa.binary())])
_PACKED_DDL = "block int, n int, ids binary, vectors binary, starts binary, orders binary"


def cells(places: np.ndarray, top: float) -> np.ndarray:
    return np.clip(np.floor(places / (CELL * top)) + CELLS // 2, 0, CELLS - 1).astype(np.int32)


def build_index(rows: DataFrame, top: float, blocks: int) -> DataFrame:
    """The index table: every usable vector is in exactly one of its rows."""
    return write_table(rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
                       .groupBy("block").applyInArrow(_pack(top, True), _PACKED_DDL), "ann-index")


def candidates(own: np.ndarray, starts: np.ndarray, orders: np.ndarray, k: int) -> np.ndarray:
    """Rows of the block that reach the collision threshold for a query whose cells are ``own``."""
    m, n = orders.shape
    need, enough, line = int(THRESHOLD * m), min(n, 4 * k + int(ENOUGH * n)), np.arange(m)

    def window(radius: int) -> tuple[np.ndarray, np.ndarray]:
        return starts[line, np.maximum(own - radius, 0)], starts[line, np.minimum(own + radius + 1, CELLS)]

    little, radius = 0, CELLS
    while radius - little > 1:  # the first window that holds the share OPEN of the block
        half = (little + radius) // 2
        low, high = window(half)
        little, radius = (little, half) if (high - low).sum() >= OPEN * m * n else (half, radius)
    low, high = window(radius)
    counts = np.bincount(np.concatenate([o[i:j] for o, i, j in zip(orders, low.tolist(), high.tolist())]), minlength=n)
    while True:
        found = np.flatnonzero(counts >= need)
        if len(found) >= enough:
            return found
        radius += STEP
        a, b = window(radius)
        ends = [o[i:j] for o, i, j in zip(orders, a.tolist(), low.tolist())]
        ends += [o[i:j] for o, i, j in zip(orders, high.tolist(), b.tolist())]
        counts += np.bincount(np.concatenate(ends), minlength=n)
        low, high = a, b


def _promising(rough: np.ndarray, k: int, top: float, q: np.ndarray) -> np.ndarray:
    """Candidates whose single-precision product may be among the k largest exact ones."""
    if len(rough) <= k:
        return np.arange(len(rough))
    slack = 1e-4 * top * float(np.sqrt((q * q).sum()))
    return np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack)


def _search(top: float, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype=np.int64)
                x = np.frombuffer(row["vectors"]).reshape(row["n"], -1)
                starts = np.frombuffer(row["starts"], dtype=np.int32).reshape(PROJECTIONS, -1)
                orders = np.frombuffer(row["orders"], dtype=np.int32).reshape(PROJECTIONS, -1)
                orders, small = orders.astype(np.intp), x.astype(np.float32)
                qids = np.frombuffer(row["q_ids"], dtype=np.int64)
                qs = np.frombuffer(row["q_vectors"]).reshape(len(qids), -1)
                own = cells((lines(x.shape[1])[:, :-1] @ qs.T.astype(np.float32)).T, top)
                out = ([], [], [])
                for i, q in enumerate(qs):
                    c = candidates(own[i], starts, orders, k)
                    c = c[ids[c] != qids[i]]
                    c = c[_promising(small[c] @ q.astype(np.float32), k, top, q)]
                    score = (x[c] * q).sum(axis=1)
                    best = np.lexsort((ids[c], -score))[:k]
                    out[0].append(np.full(len(best), qids[i]))
                    out[1].append(ids[c][best])
                    out[2].append(score[best])
                if len(qs):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], schema=schema)

    return run


def nearest(table: DataFrame, k: int = K, query_step: int = QUERY_STEP, vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: k nearest found of every row whose vec_id is
    divisible by ``query_step``."""
    spark = table.sparkSession
    prepare(spark)
    rows = usable(table, vec_col)
    size = rows.agg(F.count("*").alias("n"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    top = float(np.sqrt(size.top or 0.0))
    blocks = -(-size.n // BLOCK) or 1
    index = build_index(rows, top, blocks)
    queries = rows.filter(F.col("vec_id") % query_step == 0).dropDuplicates(["vec_id"])
    query_blocks = -(-size.n // (QUERY_BLOCK * query_step)) or 1
    packs = write_table(
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
        .groupBy("block").applyInArrow(_pack(top, False), _PACKED_DDL)
        .select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "ann-queries")
    visits = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = visits.join(index, "block").repartition(max(1, blocks * query_blocks), "block", F.xxhash64("q_ids"))
    found = met.mapInArrow(_search(top, k), "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place).cast("int")).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
