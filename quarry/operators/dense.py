"""Dense top-k by cosine similarity for a batch of queries.

D1 (exact). No pairs are formed as rows and no more than ``FEW`` queries pass through the
driver. Two plans give the same rows.

Few queries: their vectors are broadcast once, and the corpus stays where it is and passes
through Python once. A task multiplies a tile at a time (at most ``PACK`` corpus vectors and
``QUERY_PACK`` queries), takes from it the scores that reach the k-th best so far, and so ships
k rows per query, not k per batch; a final ``row_number() <= k`` (partial + final
WindowGroupLimit) merges the tasks.

Many queries: corpus and queries are dealt by their ids into groups of about ``GROUP``, and
every pair of groups is a cell of a grid, a cogroup of its own. A row goes to as many cells as
the other side has groups, so what is shuffled does not depend on the number of shuffle
partitions, nothing is broadcast, and a task holds two groups and a tile. A cell takes its
corpus by id, so that a tile gives only the scores above the k-th best so far: products in
single precision leave out the pairs that cannot reach it, the others are scored in double.

score = round(cosine, 6); order score desc, id asc. Null or zero vectors are
skipped on both sides. ``exclude_self`` drops the pair (x, x) when queries
and corpus share ids (embedding-to-embedding use).

D1a, the approximate variant, is in ``operators/approx.py``.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from quarry.config import SCORE_DECIMALS
from quarry.functions.rank import round_score, top_k

PACK, QUERY_PACK = 4096, 1024
#: Running lists that a task holds at once; more query packs than that are merged later.
HELD = 64
#: Rows of a cell's first tile: it gives the scores to beat, and each tile after it is twice as large, up to PACK.
FIRST = 256
#: Queries that are broadcast; rows of a group of the grid; cells for each core, at least.
FEW, GROUP, CELLS = 4096, 65536, 2


def _matrix(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """ids and unit vectors of the rows (id, v) whose vector is not zero."""
    lists, ids = table.column("v").combine_chunks(), table.column("id").combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return _not_zero(ids, lengths, lambda: lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))


def _units(ids: pa.Array, vectors: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The same of vectors that are arrays, one a row."""
    return _not_zero(ids, np.fromiter(map(len, vectors), np.int64, len(vectors)), lambda: np.concatenate(vectors).astype(np.float64))


def _not_zero(ids: pa.Array, lengths: np.ndarray, entries: Callable[[], np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    filled = lengths > 0
    if not filled.any():
        return ids.slice(0, 0), np.zeros((0, 0))
    dim = lengths[filled][0]
    if (lengths[filled] != dim).any():
        raise ValueError(f"vector dimension {lengths[filled][lengths[filled] != dim][0]} != {dim}")
    x = entries().reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    keep = norm > 0
    return ids.filter(pa.array(filled)).filter(pa.array(keep)), x[keep] / norm[keep, None]


def _by_id(ids: pa.Array, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    order = pc.sort_indices(ids, null_placement="at_start")
    return ids.take(order), rows[order.to_numpy()]


def _block_top_k(scores: np.ndarray, ids: np.ndarray, k: int):
    """Per column of ``scores`` (B x Q), the k best rows by (score desc, id asc).

    Returns (row_idx, col_idx) arrays. Exact with ties: every row scoring at
    least the k-th best value is a candidate, then the candidates are sorted.
    """
    b, q = scores.shape
    if b == 0 or q == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kk = min(k, b)
    kth = -np.partition(-scores, kk - 1, axis=0)[kk - 1]  # k-th largest per column
    r, c = np.nonzero((scores >= kth[None, :]) & np.isfinite(scores))
    if r.size == 0:
        return r, c
    id_rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # rank of id within batch
    order = np.lexsort((id_rank[r], -scores[r, c], c))
    r, c = r[order], c[order]
    # position within column group
    starts = np.r_[0, np.flatnonzero(np.diff(c)) + 1]
    group_start = np.repeat(starts, np.diff(np.r_[starts, c.size]))
    pos = np.arange(c.size) - group_start
    sel = pos < kk
    return r[sel], c[sel]


def _merge(rows: list[tuple], k: int) -> tuple:
    """The k best (query, id, score) of each query, as three arrays."""
    query = np.concatenate([r[0] for r in rows])
    ids = np.concatenate([r[1] for r in rows])
    score = np.concatenate([r[2] for r in rows])
    _, id_rank = np.unique(ids, return_inverse=True)
    order = np.lexsort((id_rank, -score, query))
    query = query[order]
    starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    order = order[place < k]
    return query[place < k], ids[order], score[order]


def _ranked(ids: pa.Array) -> np.ndarray:
    """The place of each id among the distinct ones, ascending, nulls first."""
    return pc.rank(ids, tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)


class Best:
    """The k best rows of each of ``n`` queries among the tiles that a task has met."""

    def __init__(self, k: int, n: int):
        self.k, self.n = k, n
        self.query, self.ids, self.score = np.zeros(0, np.int64), None, np.zeros(0)
        self.beat = np.full(n, -np.inf)

    def add(self, ids: pa.Array, score: np.ndarray) -> None:
        """Scores of a tile (rows: ids, columns: queries), not rounded; -inf is no row."""
        if self.ids is None:
            self.ids, score = ids.slice(0, 0), np.round(score, SCORE_DECIMALS)
            r, c = _block_top_k(score, _ranked(ids), self.k)
            some = score[r, c]
        else:  # what rounds to the k-th best or more; equal ones count by their ids
            r, c = np.nonzero(score > self.beat - 0.6 * 10.0 ** -SCORE_DECIMALS)
            some = np.round(score[r, c], SCORE_DECIMALS)
            fit = np.isfinite(some) & (some >= self.beat[c])
            r, c, some = r[fit], c[fit], some[fit]
        if not len(r):
            return
        rows, at = np.unique(r, return_inverse=True)
        known = pa.concat_arrays([self.ids, ids.take(pa.array(rows))])
        rank = _ranked(known)
        query, place = np.append(self.query, c), np.append(np.arange(len(self.ids)), len(self.ids) + at)
        score = np.append(self.score, some)
        order = np.lexsort((rank[place], -score, query))
        query = query[order]
        starts = np.searchsorted(query, query)
        order = order[np.arange(len(query)) - starts < self.k]
        self.query = query[np.arange(len(query)) - starts < self.k]
        self.ids, self.score = known.take(pa.array(place[order])), score[order]
        self.beat = _kth((self.query, None, self.score), self.k, self.n)


class Running:
    """Top-k lists of the query packs that a task has met, at most HELD at a time."""

    def __init__(self, k: int, key: str, id_col: str):
        self.k, self.key, self.id_col = k, key, id_col
        self.held: dict = {}

    def _give(self, pack):
        keys, best = self.held.pop(pack)
        if best.ids is not None and len(best.ids):
            yield pd.DataFrame({self.key: np.asarray(keys, dtype=object)[best.query], self.id_col: best.ids.to_pandas(), "score": best.score})

    def add(self, pack, keys, ids: pa.Array, score: np.ndarray):
        """Scores of a tile (rows: ids, columns: keys; -inf is no row); yields lists that have to go."""
        if pack not in self.held:
            if len(self.held) >= HELD:
                yield from self._give(next(iter(self.held)))
            self.held[pack] = (keys, Best(self.k, len(keys)))
        self.held[pack][1].add(ids, score)

    def rest(self):
        for pack in list(self.held):
            yield from self._give(pack)


def _scan(asked, k: int, key: str, id_col: str, id_type: pa.DataType, exclude_self: bool):
    """The k best rows of a task for each query; ``asked``: the queries' ids and unit vectors, broadcast."""
    def run(batches):
        q_ids, queries = asked.value
        packs = [(q_ids.slice(a, QUERY_PACK), queries[a:a + QUERY_PACK].T) for a in range(0, len(q_ids), QUERY_PACK)]
        best = [Best(k, len(mine)) for mine, _ in packs]
        for pdf in batches:
            if not len(pdf) or not packs:
                continue
            ids, corpus = _units(pa.array(pdf["id"], from_pandas=True).cast(id_type), pdf["v"].to_numpy())
            if len(ids) and corpus.shape[1] != queries.shape[1]:
                raise ValueError(f"vector dimension {corpus.shape[1]} != query dimension {queries.shape[1]}")
            for at in range(0, len(ids), PACK):
                some, rows = ids.slice(at, PACK), corpus[at:at + PACK]
                for (mine, vectors), found in zip(packs, best):
                    score = rows @ vectors
                    if exclude_self:
                        own = _own_places(mine, some)
                        score[own[own >= 0], np.flatnonzero(own >= 0)] = -np.inf
                    found.add(some, score)
        for (mine, _), found in zip(packs, best):
            if found.ids is not None and len(found.ids):
                yield pd.DataFrame({key: mine.take(pa.array(found.query)).to_pandas(), id_col: found.ids.to_pandas(),
                                    "score": found.score})

    return run


def _own_places(q_ids: pa.Array, c_ids: pa.Array) -> np.ndarray:
    """For each query the place of the corpus row with its id, -1 if there is none."""
    codes = pa.chunked_array([c_ids, q_ids]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    place = np.full(codes.max() + 1, -1)
    place[codes[:len(c_ids)]] = np.arange(len(c_ids))
    return place[codes[len(c_ids):]]


def _cell(k: int, key: str, id_col: str, exclude_self: bool, out: pa.Schema):
    def run(q_rows: pa.Table, c_rows: pa.Table) -> pa.Table:
        (q_ids, queries), (c_ids, corpus) = _matrix(q_rows), _by_id(*_matrix(c_rows))
        if not len(q_ids) or not len(c_ids):
            return out.empty_table()
        if corpus.shape[1] != queries.shape[1]:
            raise ValueError(f"vector dimension {corpus.shape[1]} != query dimension {queries.shape[1]}")
        own = _own_places(q_ids, c_ids) if exclude_self else np.full(len(q_ids), -1)
        found, narrow = [], corpus.astype(np.float32)
        near = (corpus.shape[1] + 4) * 2.0 ** -23  # the most that a product of unit vectors errs in single precision, and some
        for a in range(0, len(q_ids), QUERY_PACK):
            mine, self_at = queries[a:a + QUERY_PACK], own[a:a + QUERY_PACK]
            narrow_mine = np.ascontiguousarray(mine.T.astype(np.float32))
            best, beat, at, size = None, np.full(len(mine), -np.inf), 0, min(FIRST, PACK)
            while at < len(c_ids):
                here = np.flatnonzero((self_at >= at) & (self_at < at + size))
                if best is None:
                    score = corpus[:size] @ mine.T
                    score[self_at[here], here] = -np.inf
                    score = np.round(score, SCORE_DECIMALS)
                    r, c = _block_top_k(score, np.arange(len(score)), k)
                    best, beat = (c, r, score[r, c]), None
                else:  # later ids: a rounded score that is not above the k-th best adds nothing
                    score = narrow[at:at + size] @ narrow_mine
                    score[self_at[here] - at, here] = -np.inf
                    r, c = np.divmod(np.flatnonzero(score > (beat - near).astype(np.float32)), len(mine))
                    r += at
                    some = np.round(np.einsum("ij,ij->i", corpus[r], mine[c]), SCORE_DECIMALS)
                    fit = np.isfinite(some) & (some > beat[c])
                    if fit.any():
                        best, beat = _merge([best, (c[fit], r[fit], some[fit])], k), None
                at, size = at + size, min(2 * size, PACK)
                if beat is None:
                    beat = _kth(best, k, len(mine))
            found.append((best[0] + a, best[1], best[2]))
        query, place, score = (np.concatenate(x) for x in zip(*found))
        return pa.Table.from_arrays([q_ids.take(pa.array(query)), c_ids.take(pa.array(place)), pa.array(score)], schema=out)

    return run


def _kth(best: tuple, k: int, n: int) -> np.ndarray:
    """The k-th best score of each of n queries, -inf of those with fewer."""
    query, _, score = best
    last = np.full(n, np.inf)
    np.minimum.at(last, query, score)
    return np.where(np.bincount(query, minlength=n) >= k, last, -np.inf)


def _grid(n_queries: int, n_corpus: int, cores: int) -> tuple[int, int]:
    """Groups of the queries and of the corpus: GROUP rows at most, and cells enough for all cores."""
    a, b = -(-n_queries // GROUP) or 1, -(-n_corpus // GROUP) or 1
    while a * b < CELLS * cores and max(n_queries // a, n_corpus // b) > 1:
        if n_queries // a >= n_corpus // b:
            a += 1
        else:
            b += 1
    return a, b


def _filled(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")


def _grid_top_k(queries: DataFrame, corpus: DataFrame, n_queries: int, k: int, key: str, id_col: str, vector: str,
                exclude_self: bool, schema: T.StructType) -> DataFrame:
    a, b = _grid(n_queries, corpus.select(id_col).count(), corpus.sparkSession.sparkContext.defaultParallelism)

    def dealt(df, name, mine, other, groups, others):
        rows = _filled(df, name, vector).withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return rows.repartition(a * b, "_i", "_j").groupBy("_i", "_j")

    cells = dealt(queries, key, "_i", "_j", a, b).cogroup(dealt(corpus, id_col, "_j", "_i", b, a))
    return cells.applyInArrow(_cell(k, key, id_col, exclude_self, to_arrow_schema(schema)), schema)


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, key: str = "query_id",
                id_col: str = "node_id", vector: str = "vector", exclude_self: bool = False) -> DataFrame:
    """(key, id_col, score, rank) with the k best corpus rows per query."""
    schema = T.StructType([T.StructField(key, queries.schema[key].dataType),
                           T.StructField(id_col, corpus.schema[id_col].dataType),
                           T.StructField("score", T.DoubleType())])
    n_queries = queries.select(key).count()
    if n_queries > FEW:
        found = _grid_top_k(queries, corpus, n_queries, k, key, id_col, vector, exclude_self, schema)
    else:
        asked, rows = _filled(queries, key, vector), _filled(corpus, id_col, vector)
        few = corpus.sparkSession.sparkContext.broadcast(_matrix(asked.toArrow()))  # FEW vectors at most
        id_type = to_arrow_type(corpus.schema[id_col].dataType)
        found = rows.mapInPandas(_scan(few, k, key, id_col, id_type, exclude_self), schema)
    return top_k(found.withColumn("score", round_score("score")), [key], k, id_col=id_col)
