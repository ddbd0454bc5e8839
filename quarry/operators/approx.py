"""Approximate dense top-k by sign-bit signatures with probes.

Each of ``TABLES`` tables has as many random planes as the corpus needs (``signature_bits``); the
sides on which a vector lies are its signature in that table. A corpus vector stands under
its signature, a query looks under its own and under every signature that differs in one
bit. Signatures that differ in one bit at most agree on their first half or on their last one, so
a vector goes to two cogroups of a table, (table, half, bits of that half), and no probe is sent:
where the first halves agree, the last ones may be equal or differ in a bit; where the last ones agree,
the first ones differ in a bit. A group scores the pairs that met in matrix products and gives,
for each query, those down to its k-th best; no other pair leaves the task. Two vectors at a small angle
agree on most planes, so close pairs meet in some table; of unrelated pairs few do. Pairs
that met are scored exactly, by the contract of D1. Vectors travel as they came, in the input's precision.

Skew: equal vectors are one row until the end (of each group of copies only the k + 1
smallest ids can be asked for), on the query side too; a group that more than ``HOT`` different
vectors share is cut into pieces of about that many, which its queries, cut as often, meet
pairwise, so that no task holds a whole cluster. Planes come from a hash of their numbers, so
that reruns, and other engines, have the same ones.

Recall is that of the angle: with eleven bits and eight tables a pair at cosine 0.9 is found
with probability 0.997, at 0.8 with 0.95, at 0.35 with about 0.3, while about 5 % of
unrelated pairs are scored. Use D1 where neighbours are no closer than that.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import SCORE_DECIMALS
from quarry.functions.rank import round_score, top_k
from quarry.session import settle

TABLES, LEAST_BITS, MOST_BITS, BUCKET, HOT = 8, 11, 24, 64, 32768
#: Queries scored at once; what rounding may hide.
TILE, SLACK = 1024, 2 * 10.0 ** -SCORE_DECIMALS


def signature_bits(n: int) -> int:
    """Planes of a table so that a signature holds about ``BUCKET`` of n unrelated vectors."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / BUCKET))))


def planes(bits: int, dim: int) -> np.ndarray:
    """(tables, bits, dim) components in [-0.5, 0.5), from the MD5 of ``table-bit-dimension``."""
    cells = [int(hashlib.md5(f"{t}-{b}-{d}".encode()).hexdigest()[:8], 16) / 2 ** 32 - 0.5
             for t in range(TABLES) for b in range(bits) for d in range(dim)]
    return np.array(cells).reshape(TABLES, bits, dim)


def _signed(df: DataFrame, id_col: str, vector: str, bits: int, dim: int) -> DataFrame:
    """id, class (digest of the vector), vector and signatures of the vectors that are not null or zero."""
    id_type = df.schema[id_col].dataType
    single = df.schema[vector].dataType == T.ArrayType(T.FloatType())
    given = T.ArrayType(T.FloatType() if single else T.DoubleType())
    schema = T.StructType([T.StructField("id", id_type), T.StructField("cls", T.BinaryType()),
                           T.StructField("vec", given), T.StructField("sigs", T.ArrayType(T.IntegerType()))])

    def run(batches):
        walls = planes(bits, dim).reshape(-1, dim)
        weights = 1 << np.arange(bits)
        for batch in batches:
            column = batch.column("v")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            if len(lengths) and (lengths != dim).any():
                raise ValueError(f"vector dimension {lengths[lengths != dim][0]} != {dim}")
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim) + 0.0
            norm = np.sqrt((x * x).sum(axis=1))
            keep = norm > 0
            sigs = ((x[keep] @ walls.T >= 0).reshape(-1, TABLES, bits) * weights).sum(axis=2).astype(np.int32)
            ids, vec = batch.column("id").filter(pa.array(keep)), x[keep].astype(np.float32 if single else np.float64)
            offsets = lambda width: pa.array(np.arange(len(vec) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([hashlib.sha256(row.tobytes()).digest()[:16] for row in x[keep]], pa.binary()),
                 pa.ListArray.from_arrays(offsets(dim), pa.array(vec.ravel())),
                 pa.ListArray.from_arrays(offsets(TABLES), pa.array(sigs.ravel()))], names=["id", "cls", "vec", "sigs"])

    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    return rows.mapInArrow(run, schema)


def _classes(signed: DataFrame) -> DataFrame:
    return signed.groupBy("cls").agg(F.first("vec").alias("vec"), F.first("sigs").alias("sigs"))


def _near(k: int, least: float):
    """Cogroup of a group of signatures: asking vectors (q, q_vec, half, sig, bits) and standing ones (c, c_vec, sig)
    -> of each q the pairs of its probes down to the k-th best score, ties included; sig: the ``bits`` of the other half."""
    def units(table: pa.Table, vec: str) -> np.ndarray:
        x = table.column(vec).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
        return x / np.sqrt((x * x).sum(axis=1))[:, None]

    def run(asked: pa.Table, placed: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and placed.num_rows:
            placed, asked = placed.sort_by("sig"), asked.sort_by("sig")
            corpus, queries = units(placed, "c_vec"), units(asked, "q_vec")
            bits, own = asked.column("bits")[0].as_py(), asked.column("half")[0].as_py() == 0
            begin = np.searchsorted(placed.column("sig").to_numpy(), np.arange((1 << bits) + 1))
            look = asked.column("sig").to_numpy()
            edges = np.flatnonzero(np.append(True, look[1:] != look[:-1])).tolist() + [len(look)]
            for a, b in zip(edges, edges[1:]):
                sig = int(look[a])
                cells = [*([sig] if own else []), *(sig ^ (1 << x) for x in range(bits))]
                at = np.concatenate([np.arange(begin[s], begin[s + 1]) for s in cells])
                if not len(at):
                    continue
                some = corpus[at]
                for i in range(a, b, TILE):
                    score = queries[i:min(i + TILE, b)] @ some.T
                    kth = -np.partition(-score, min(k, len(at)) - 1, axis=1)[:, min(k, len(at)) - 1]
                    q, c = np.nonzero((score >= kth[:, None] - SLACK) & (score >= least - SLACK))
                    found.append((i + q, at[c], score[q, c]))
        q, c, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"q": asked.column("q").take(pa.array(q)), "c": placed.column("c").take(pa.array(c)), "score": pa.array(score)})

    return run


def candidates(queries: DataFrame, corpus: DataFrame, bits: int, k: int = 1 << 30, min_cosine: float = -1.0) -> DataFrame:
    """(q, c, score): pairs of classes that met in some table, once each, scored exactly: of each query
    all down to the k-th best, ties included, and some below."""
    low = bits // 2
    first, last = F.expr(f"_s >> {low}"), F.col("_s").bitwiseAND(F.lit((1 << low) - 1))
    halves = F.explode(F.array(*(F.struct(F.lit(half).alias("half"), group.cast("int").alias("group"), sig.cast("int").alias("sig"),
                                          F.lit(width).alias("bits"))
                                 for half, group, sig, width in ((0, first, last, low), (1, last, first, bits - low)))))

    def grouped(rows, key, vec):
        rows = rows.select(F.col("cls").alias(key), F.col("vec").alias(vec), F.posexplode("sigs").alias("table", "_s"))
        return rows.select(key, vec, "table", halves.alias("_h")).select(key, vec, "table", "_h.half", "_h.group", "_h.sig", "_h.bits")

    placed, asked = grouped(corpus, "c", "c_vec"), grouped(queries, "q", "q_vec")
    group = ["table", "half", "group"]
    hot = settle(placed.groupBy(*group).count().filter(F.col("count") > HOT)
                 .select(*group, F.ceil(F.col("count") / HOT).cast("int").alias("pieces")), "hot-signatures")

    def dealt(rows, key, mine, other):
        pieces = F.coalesce("pieces", F.lit(1))
        rows = rows.join(hot, group, "left").withColumn(mine, F.pmod(F.xxhash64(key), pieces).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces").groupBy(*group, "_i", "_j")

    met = dealt(asked, "q", "_i", "_j").cogroup(dealt(placed, "c", "_j", "_i")) \
        .applyInArrow(_near(k, min_cosine), "q binary, c binary, score double")
    # dealt by query: what follows, here and in ``_with_ties``, needs no other exchange
    return met.select("q", "c", round_score("score").alias("score")).repartition("q").groupBy("q", "c").agg(F.max("score").alias("score"))


def approx_dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, key: str = "query_id", id_col: str = "node_id",
                       vector: str = "vector", min_cosine: float = -1.0, exclude_self: bool = False) -> DataFrame:
    """(key, id_col, score, rank), k best of the corpus rows found for each query."""
    size = corpus.filter(F.col(vector).isNotNull()).agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    bits, dim = signature_bits(size.n), size.d or 0
    if not dim:
        types = (queries.schema[key].dataType, corpus.schema[id_col].dataType, T.DoubleType(), T.IntegerType())
        return corpus.sparkSession.createDataFrame(
            [], T.StructType([T.StructField(n, t) for n, t in zip((key, id_col, "score", "rank"), types)]))
    c = settle(_signed(corpus, id_col, vector, bits, dim), "signed-corpus")
    q = settle(_signed(queries, key, vector, bits, dim), "signed-queries")
    pairs = candidates(_classes(q), _classes(c), bits, k + 1, min_cosine).filter(F.col("score") >= min_cosine)
    # of each group of copies the k + 1 smallest ids; one of them may be the query's own
    first = top_k(c.select("cls", "id", F.lit(0).alias("score")), ["cls"], k + 1, id_col="id").select(F.col("cls").alias("c"), "id")
    found = top_k(_with_ties(pairs, k + 1).join(first, "c"), ["q"], k + 1, id_col="id").drop("rank", "c")
    rows = q.select(F.col("id").alias(key), F.col("cls").alias("q")).join(found, "q")
    if exclude_self:
        rows = rows.filter(F.col(key) != F.col("id"))
    return top_k(rows.select(key, F.col("id").alias(id_col), "score"), [key], k, id_col=id_col)


def _with_ties(pairs: DataFrame, k: int) -> DataFrame:
    """Each query's pairs down to the k-th best score, ties included: classes are not ids, so ties stay open."""
    better = Window.partitionBy("q").orderBy(F.desc("score"))
    return pairs.withColumn("_r", F.rank().over(better)).filter(F.col("_r") <= k).drop("_r")
