"""Keyword (BM25) top-k for a whole batch of queries at once.

    score(q, node) = sum over distinct query terms t present in the node of
        idf(t) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    idf(t) = ln(1 + (N - df + 0.5) / (df + 0.5)),  k1 = 1.5, b = 0.75

Two plans give the same rows; ``keyword_top_k`` picks one by what each would move.

``selective_bm25_top_k`` reads only postings that can matter. (1) From the bounds of the
blocks of the batch's terms: the best share that each term can have. (2) Of the nodes in
the first blocks of each term, those of the best partial sums are scored whole; the k-th
best of a query is a score that its top k reach at least. (3) Terms whose bounds together stay below it cannot bring a node into
the top k on their own; of the other terms, a block is read if its bound plus the other
terms' bounds reach that score. (4) Nodes whose sum plus the bounds of the terms left out
still reach the k-th best are scored whole, from their rows of the forward table, which is
pruned to their partitions. A stopword's postings are read only where a query has little else.

``bm25_top_k`` reads the forward table (a node's terms in one row) and scores nodes where
they are: for batches whose terms cover much of the corpus. Rows are packed within their
partition (at most ``PACK_TERMS`` terms), query terms by query (``QUERY_PACK`` queries), and
the packs meet in an equi-join. As in D1 up to ``FEW`` queries are broadcast once; of more, the
packs are repeated for every block, and the planner broadcasts them by their bytes or shuffles
both sides. A task adds up, for each node, the weighted
query rows of its matching terms (a sparse-by-dense product) and keeps a running top-k per
query pack. No (query, node) pair leaves a task unless it is in that task's top-k, however
common a term is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import BM25_B, BM25_K1, SCORE_DECIMALS
from quarry.functions.rank import round_score, top_k
from quarry.functions.text import stem, words
from quarry.operators.dense import FEW, Running
from quarry.operators.index import TextIndex
from quarry.operators.postings import bucket_of, expand_blocks, share
from quarry.session import settle

PACK_TERMS, QUERY_PACK = 65536, 1024
#: Cells (node, query) that are scored at once; query packs that a task keeps prepared; cells of a matrix product at
#: the price of one that is added to on its own.
TILE_CELLS, KNOWN_PACKS, SPREAD = 1 << 19, 64, 400
#: Terms of the forward table that are scanned at the price of one posting that is joined, shuffled and scored.
PAIR_COST = 16
#: First blocks of a term whose nodes are tried, nodes of them (times k) that are scored whole, what
#: rounding may hide, and terms that are pushed down to the scan by name.
SEED_BLOCKS, TRIED, SLACK, PUSHED = 4, 4, 2 * 10.0 ** -SCORE_DECIMALS, 1000


def query_terms(queries: DataFrame, text: str = "text", with_stemming: bool = False,
                key: str = "query_id") -> DataFrame:
    """Distinct retrieval terms of each query: (query_id, term)."""
    toks = words(text)
    if with_stemming:
        toks = F.transform(toks, stem)
    return queries.select(key, F.explode(F.array_distinct(toks)).alias("term"))


def idf_expr(df_col="df", n=None):
    return F.log(F.lit(1.0) + (n - F.col(df_col) + F.lit(0.5)) / (F.col(df_col) + F.lit(0.5)))


def query_term_idf(queries: DataFrame, index: TextIndex, text: str = "text", key: str = "query_id") -> DataFrame:
    """(query_id, term, df, idf) for query terms that occur in the corpus, written once."""
    qt = query_terms(queries, text, index.cfg.layout.stemming, key)
    qidf = qt.join(index.df, "term").select(key, "term", "df", idf_expr("df", index.n_nodes()).alias("idf"))
    return settle(qidf, "query-terms")


_PACKED = pa.schema([("_ids", pa.list_(pa.string())), ("_terms", pa.list_(pa.string())), ("_tfs", pa.list_(pa.int32())),
                     ("_size", pa.list_(pa.int32())), ("_dl", pa.list_(pa.int32()))])


def _pack_nodes(batches):
    """Rows of up to PACK_TERMS terms (a longer node is alone): ids, their terms and counts one
    after the other, terms per node, lengths."""
    for batch in batches:
        sizes = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            before = sizes[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(sizes, before + PACK_TERMS, side="right")))
            part = batch.slice(i, j - i)
            i = j
            columns = [part.column("node_id"), part.column("terms").flatten(), part.column("tfs").flatten(),
                       part.column("terms").value_lengths(), part.column("dl")]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c.cast(f.type.value_type))
                     for c, f in zip(columns, _PACKED)]
            yield pa.RecordBatch.from_arrays(lists, schema=_PACKED)


class Asked:
    """The terms of a query pack. What a posting of a term adds goes to each query that has the term: terms that would
    add to many cells are columns of a matrix product, the others are spread out posting by posting."""

    def __init__(self, q_keys, q_terms, q_idfs):
        keys, q_of = np.unique(np.asarray(list(q_keys)), return_inverse=True)
        self.keys, n = keys.tolist(), len(keys)
        coded = pa.array(q_terms, pa.string()).dictionary_encode()
        self.terms, t_of, idf = coded.dictionary, coded.indices.to_numpy(), np.asarray(q_idfs, dtype=float)
        asking = np.bincount(t_of, minlength=len(self.terms))
        held_by = np.zeros(len(self.terms))  # about the share of the nodes that hold a term
        held_by[t_of] = np.exp(-idf)
        common = held_by * asking * SPREAD > n
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.matrix = np.zeros((int(common.sum()), n))
        many = common[t_of]
        self.matrix[self.column[t_of[many]], q_of[many]] = idf[many]
        order = np.argsort(t_of, kind="stable")
        self.query, self.idf, self.begin = q_of[order], idf[order], np.append(0, np.cumsum(asking))

    def score(self, n: int, node: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(nodes x queries) sums, of postings (node, term, weight); -inf where a node has no term of a query."""
        width = len(self.keys)
        many = self.column[term] >= 0
        held = np.zeros((n, len(self.matrix)))
        held[node[many], self.column[term[many]]] = weight[many]
        score = held @ self.matrix
        node, term, weight = node[~many], term[~many], weight[~many]
        each = self.begin[term + 1] - self.begin[term]
        at = np.repeat(self.begin[term] - np.append(0, np.cumsum(each)[:-1]), each) + np.arange(each.sum())
        cells = np.repeat(node, each) * width + self.query[at]
        score += np.bincount(cells, weights=np.repeat(weight, each) * self.idf[at], minlength=n * width).reshape(n, width)
        # weights and idfs are above zero, so a sum is as well if the node has a term of the query
        return np.where(score > 0, score, -np.inf)


def _score_packs(k: int, key: str, avgdl: float, k1: float, b: float):
    def run(batches):
        running, known = Running(k, key, "node_id"), {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                name = (tuple(row.q_keys), tuple(row.q_terms))
                if name not in known:
                    if len(known) >= KNOWN_PACKS:
                        known.clear()
                    known[name] = Asked(row.q_keys, row.q_terms, row.q_idfs)
                asked = known[name]
                size, dl, ids = np.asarray(row.size_), np.asarray(row.dl_, dtype=float), pa.array(row.ids_, pa.string())
                term = pc.fill_null(pc.index_in(pa.array(row.terms_, pa.string()), value_set=asked.terms), -1).to_numpy()
                node = np.repeat(np.arange(len(size)), size)[term >= 0]
                tf, term = np.asarray(row.tfs_, dtype=float)[term >= 0], term[term >= 0]
                weight = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl[node] / avgdl))
                step = max(1, TILE_CELLS // max(len(asked.keys), 1))
                for at in range(0, len(size), step):
                    i, j = np.searchsorted(node, (at, at + step))
                    if i < j:
                        some = ids.slice(at, step)
                        score = asked.score(len(some), node[i:j] - at, term[i:j], weight[i:j])
                        yield from running.add(name, asked.keys, some, score)
        yield from running.rest()

    return run


def bm25_top_k(queries: DataFrame, index: TextIndex, k: int, text: str = "text",
               key: str = "query_id", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """D2 by the forward table: k best nodes per query: (query_id, node_id, score, rank)."""
    return _scan_top_k(query_term_idf(queries, index, text, key), queries.schema[key].dataType, index, k, key, k1, b)


def _scan_top_k(qidf: DataFrame, key_type: T.DataType, index: TextIndex, k: int, key: str, k1: float, b: float) -> DataFrame:
    spark = index.forward.sparkSession
    schema = T.StructType([T.StructField(key, key_type), T.StructField("node_id", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    packs = -(-qidf.select(key).distinct().count() // QUERY_PACK) or 1
    stats = index.stats.first()  # one row
    few = packs * QUERY_PACK <= FEW
    blocks = 1 if few else int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    q = settle(qidf.groupBy(F.pmod(F.xxhash64(key), F.lit(packs)).alias("_pack")).agg(
        F.collect_list(key).alias("q_keys"), F.collect_list("term").alias("q_terms"),
        F.collect_list("idf").alias("q_idfs")).drop("_pack"), "query-packs")
    # few queries are broadcast as they are, and the corpus stays where it is
    q = F.broadcast(q.withColumn("_block", F.pmod(F.xxhash64("q_keys"), F.lit(1)).cast("int"))) if few else \
        q.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    nodes = index.forward.filter("dl > 0").select("node_id", "terms", "tfs", "dl").mapInArrow(
        _pack_nodes, "_ids array<string>, _terms array<string>, _tfs array<int>, _size array<int>, _dl array<int>")
    nodes = nodes.select(F.pmod(F.xxhash64("_ids"), F.lit(blocks)).cast("int").alias("_block"), F.col("_ids").alias("ids_"),
                         F.col("_terms").alias("terms_"), F.col("_tfs").alias("tfs_"), F.col("_size").alias("size_"),
                         F.col("_dl").alias("dl_"))
    found = nodes.join(q, "_block").drop("_block").mapInPandas(
        _score_packs(k, key, float(stats.avgdl or 1.0), k1, b), schema)
    return top_k(found.withColumn("score", round_score("score")), [key], k)


class Selection:
    """What a batch has to read: steps 1 to 3 of the selective plan, each written once.

    ``terms``: key, term, idf, best (the most the term can add), need (the least share that a
    block must have; null where the query leaves the term out); ``floors``: key, floor (a score
    that the top k reach), rest (the most that the terms left out add); ``pairs``: postings that
    are read for queries."""

    def __init__(self, found: DataFrame, index: TextIndex, k: int, key: str, k1: float, b: float):
        self.index, self.k, self.key, self.k1, self.b = index, k, key, k1, b
        stats = index.stats.first()  # one row
        self.avgdl = float(stats.avgdl or 1.0)
        # at most as many numbers as there are buckets; they prune the scan of the blocks, a few terms its row groups too
        buckets = [r[0] for r in found.select(bucket_of("term", index.buckets)).distinct().collect()]
        pushed = [r[0] for r in found.select("term").distinct().limit(PUSHED + 1).collect()]
        self.blocks = blocks = index.blocks.filter(
            F.col("bucket").isin(buckets) & (F.col("term").isin(pushed) if len(pushed) <= PUSHED else F.lit(True)))
        heads = blocks.select("term", "v", "block", "n", self._share("max_tf", "min_dl").alias("top")) \
            .join(found.select("term").distinct(), "term")
        self.heads = settle(heads, "block-bounds")
        best = self.heads.groupBy("term").agg(F.max("top").alias("top"))
        self.found = settle(found.join(best, "term").select(key, "term", "idf", (F.col("idf") * F.col("top")).alias("best")),
                            "term-bounds")
        first = Window.partitionBy("term").orderBy(F.desc("top"), "v", "block")
        seeds = self.heads.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= SEED_BLOCKS)
        # the best of these nodes are scored whole: their k-th best is the score to beat
        tried = top_k(self._partial(settle(seeds.select("v", "block"), "seed-blocks"), self.found), [key], TRIED * k)
        self.listed = settle(self.found.groupBy(key).agg(F.collect_list(F.struct("term", "idf")).alias("_q")), "query-lists")
        floor = self._kth(self._whole(settle(self._placed(tried), "tried")))
        rising = Window.partitionBy(key).orderBy("best", "term")
        everything = Window.partitionBy(key)
        terms = self.found.join(floor, key, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK) \
            .withColumn("below", F.sum("best").over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow))) \
            .withColumn("total", F.sum("best").over(everything))
        need = (F.col("floor") - F.col("total") + F.col("best")) / F.col("idf")
        terms = terms.withColumn("need", F.when(F.col("below") >= F.col("floor"), need))
        self.terms = settle(terms.select(key, "term", "idf", "best", "need", "floor"), "needs")
        self.floors = self.terms.groupBy(key).agg(F.first("floor").alias("floor"), F.coalesce(
            F.sum(F.when(F.col("need").isNull(), F.col("best"))), F.lit(0.0)).alias("rest"))
        self.pairs = self.heads.join(self.terms.filter("need IS NOT NULL"), "term").filter("top >= need") \
            .agg(F.sum("n")).first()[0] or 0

    def _share(self, tf: str, dl: str):
        return share(F.col(tf), F.col(dl), F.lit(self.avgdl), self.k1, self.b)

    def _partial(self, chosen: DataFrame, terms: DataFrame) -> DataFrame:
        """key, node_id, doc_id, score: sums over the postings of the chosen blocks (v, block)."""
        blocks = self.blocks.join(chosen, ["v", "block"], "left_semi")
        rows = expand_blocks(blocks, self.index.cfg, self.index.live_posting) \
            .select("term", "node_id", "doc_id", self._share("tf", "dl").alias("_w"))
        pairs = rows.join(terms, "term")
        if "need" in terms.columns:
            pairs = pairs.filter("need IS NOT NULL")
        return pairs.groupBy(self.key, "node_id", "doc_id").agg(F.sum(F.col("_w") * F.col("idf")).alias("score"))

    def _placed(self, nodes: DataFrame) -> DataFrame:
        """The nodes with the partition that holds them."""
        part = F.pmod(F.xxhash64("doc_id"), F.lit(self.index.parts)).cast("int")
        return nodes.withColumn("part", part).drop("doc_id")

    def _whole(self, nodes: DataFrame) -> DataFrame:
        """key, node_id, score: whole scores of (key, node_id, part), from their rows of the forward table."""
        key = self.key
        # the filter makes the planner prune the forward table to these partitions as it runs
        wanted = nodes.filter("part >= 0").select(key, "node_id", "part")
        rows = self.index.forward.select("node_id", "part", "terms", "tfs", "dl").join(wanted, ["part", "node_id"])

        def term_score(t):
            idf = F.get(F.filter("_q", lambda q: q["term"] == t["terms"]), 0)["idf"]
            return F.coalesce(share(t["tfs"], F.col("dl"), F.lit(self.avgdl), self.k1, self.b) * idf, F.lit(0.0))

        shares = F.transform(F.arrays_zip("terms", "tfs"), term_score)
        return rows.join(self.listed, key).select(key, "node_id", F.aggregate(shares, F.lit(0.0), lambda a, x: a + x).alias("score"))

    def _kth(self, scored: DataFrame) -> DataFrame:
        """key, floor: the k-th best score of the queries that have k nodes."""
        best = top_k(scored, [self.key], self.k)
        return best.filter(F.col("rank") == self.k).select(self.key, F.col("score").alias("floor"))

    def search(self) -> DataFrame:
        """Step 4: (key, node_id, score, rank)."""
        key = self.key
        chosen = self.heads.join(self.terms.filter("need IS NOT NULL"), "term").filter("top >= need") \
            .select("v", "block").distinct()
        partial = settle(self._partial(settle(chosen, "chosen-blocks"), self.terms.select(key, "term", "idf", "need")), "partial")
        floor = self._kth(partial).withColumnRenamed("floor", "kth")
        left = partial.join(self.floors, key).join(floor, key, "left") \
            .filter(F.col("score") + F.col("rest") >= F.greatest("floor", F.coalesce("kth", F.lit(0.0)) - SLACK))
        left = settle(self._placed(left.select(key, "node_id", "doc_id", "score", "rest")), "survivors")
        whole = left.filter("rest = 0").select(key, "node_id", "score")
        rescored = self._whole(left.filter("rest > 0"))
        found = whole.unionByName(rescored).withColumn("score", round_score("score"))
        return top_k(found, [key], self.k)


def selective_bm25_top_k(queries: DataFrame, index: TextIndex, k: int, text: str = "text",
                         key: str = "query_id", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """D2 by postings: k best nodes per query: (query_id, node_id, score, rank)."""
    return Selection(query_term_idf(queries, index, text, key), index, k, key, k1, b).search()


def expected_pairs(found: DataFrame, k: int, key: str) -> int:
    """Postings that the selective plan is likely to read for queries, from their terms alone: a
    posting of usual length adds about its idf and at most about half as much again, so the rarest
    term of k nodes stands for the score to beat, and the commonest terms stay out while they add less."""
    rising = Window.partitionBy(key).orderBy("idf", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beat = F.max(F.when(F.col("df") >= k, F.col("idf"))).over(Window.partitionBy(key))
    read = found.withColumn("below", 1.5 * F.sum("idf").over(rising)).withColumn("beat", F.coalesce(beat, F.lit(0.0)))
    return read.filter("below >= beat").agg(F.sum("df")).first()[0] or 0


def keyword_top_k(queries: DataFrame, index: TextIndex, k: int, text: str = "text",
                  key: str = "query_id", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """D2 by the plan that moves less: the selected postings, once for each query that needs
    them, or every term of the corpus once."""
    found = query_term_idf(queries, index, text, key)
    total = index.stats.first()["total"] or 0
    if PAIR_COST * expected_pairs(found, k, key) <= total:
        chosen = Selection(found, index, k, key, k1, b)
        if PAIR_COST * chosen.pairs <= total:
            return chosen.search()
    return _scan_top_k(found, queries.schema[key].dataType, index, k, key, k1, b)
