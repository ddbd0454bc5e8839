"""Findings of round 3: dense search of many queries, streams of folders, index build and approximate search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense as D
from quarry.operators.dense import dense_top_k

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("exclude_self", [False, True])
def test_dense_grid_equals_broadcast(spark, monkeypatch, exclude_self):
    """Many queries: cells of a grid, several tiles each, ties, copies, nulls and zeros, string ids."""
    rng = np.random.default_rng(3)
    vecs = rng.integers(-2, 3, size=(300, 3)).astype(float)
    rows = [(f"n{i}", v.tolist()) for i, v in enumerate(vecs)] + [("none", None), ("zero", [0.0] * 3)]
    c = spark.createDataFrame(rows, "vec_id string, vector array<double>").repartition(3)
    q = c.withColumnRenamed("vec_id", "query_id")
    few = {tuple(r) for r in dense_top_k(q, c, 4, id_col="vec_id", exclude_self=exclude_self).collect()}
    monkeypatch.setattr(D, "FEW", 0)
    monkeypatch.setattr(D, "GROUP", 120)
    monkeypatch.setattr(D, "PACK", 16)
    monkeypatch.setattr(D, "QUERY_PACK", 20)
    many = [tuple(r) for r in dense_top_k(q, c, 4, id_col="vec_id", exclude_self=exclude_self).collect()]
    assert set(many) == few and len(many) == len(few)


def test_dense_many_queries_are_not_broadcast(spark):
    """What goes through the driver does not grow with the queries."""
    q = spark.range(D.FEW + 1).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    p = dense_top_k(q, q.withColumnRenamed("query_id", "node_id"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in p and "FlatMapCoGroupsInArrow" in p
    assert D._grid(1_000_000, 3_000_000, 12) == (16, 46)  # by rows alone, whatever the shuffle partitions


def test_stream_nodes_reads_a_folder(spark, scratch):
    from quarry.config import RagConfig
    from quarry.operators.chunk import sentence_window_nodes
    from quarry.streaming.ingest import stream_nodes

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    docs.repartition(3).write.parquet(f"{scratch}/in/documents.parquet")
    got = stream_nodes(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck", RagConfig())
    want = sentence_window_nodes(spark.read.parquet(f"{scratch}/in/documents.parquet"), 3)
    columns = ["node_id", "doc_id", "pos", "text", "window"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    none = stream_nodes(spark, f"{scratch}/in", f"{scratch}/out2", f"{scratch}/ck2", RagConfig(), glob="absent*.parquet")
    assert none.count() == 0


def test_postings_are_gathered_before_the_shuffle(spark, monkeypatch):
    """Blocks hold every posting once with right bounds, whatever the batches; the shuffle has no row per posting."""
    from quarry.operators import postings as P

    rows = [(d, p, 1 + (d * 7 + p) % 9, [f"t{j}" for j in range((d + p) % 5)] + ["é"], [1 + (d + j) % 3 for j in range((d + p) % 5)] + [d + 1])
            for d in range(40) for p in range(8)] + [(99, 0, 0, [], [])]
    forward = spark.createDataFrame(rows, "doc_id long, pos int, dl int, terms array<string>, tfs array<int>").repartition(3)
    blocks = P.build_blocks(forward, 4)
    assert "data" in blocks._jdf.queryExecution().executedPlan().toString()
    got = []
    for b in blocks.collect():
        assert b.n == len(b.doc_ids) <= P.BLOCK and b.max_tf == max(b.tfs) and b.min_dl == min(b.dls)
        got += [(b.term, *x) for x in zip(b.doc_ids, b.poss, b.tfs, b.dls)]
    assert sorted(got) == sorted((t, d, p, f, dl) for d, p, dl, terms, tfs in rows for t, f in zip(terms, tfs))


def test_term_counts_and_vectors_by_batch(spark):
    """Terms by bytes with counts, and the unit vector of their buckets; texts without words and nulls."""
    import hashlib
    from collections import Counter

    from quarry.operators.embed import Embedder, with_terms

    texts = ["b a B ä z Z", "", None, "... !", "x", "\U0001d41a ﬁ b é a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    for r in Embedder(dim=16).embed(with_terms(df)).collect():
        words = Counter(w for w in (r.text or "").lower().split() if w.isalnum())
        terms = sorted(words, key=lambda w: w.encode())
        assert r._ts.terms == terms and r._ts.tfs == [words[t] for t in terms]
        v = np.zeros(16)
        for t in terms:
            v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 16] += words[t]
        assert r.vector is None if not terms else r.vector == list(v / np.sqrt((v * v).sum()))


def test_approximate_search_gives_each_query_few_pairs(spark, monkeypatch):
    """A group gives the pairs down to the k-th best alone; the best of all pairs that met are among them."""
    from quarry.functions.rank import top_k
    from quarry.operators import approx

    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 6)))]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    classes = approx._classes(approx._signed(df, "vec_id", "vector", 11, 6)).localCheckpoint()
    whole = approx.candidates(classes, classes, 11)
    for hot in (32768, 100):
        monkeypatch.setattr(approx, "HOT", hot)
        few = approx.candidates(classes, classes, 11, 4).localCheckpoint()
        assert few.count() < whole.count() / 2
        best = [{(bytes(r.q), r["rank"], r.score) for r in top_k(x, ["q"], 4, id_col="c").collect()} for x in (few, whole)]
        assert best[0] == best[1]


def test_few_keyword_queries_are_not_repeated(spark, scratch):
    """The query packs of a small batch are broadcast once, not for each shuffle partition."""
    from quarry.config import RagConfig
    from quarry.operators.sparse import bm25_top_k
    from quarry.sources.index_store import ensure_index

    docs = spark.createDataFrame([(i, f"Word{i % 3} here. And word{i} there.") for i in range(30)], "doc_id long, text string")
    idx = ensure_index(spark, docs, "p", RagConfig().but(layout={"partitions": 1}), path=f"{scratch}/idx")
    q = spark.createDataFrame([(1, "word1 there"), (2, "word2 here")], "query_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = bm25_top_k(q, idx, 3)
        p = hits._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in p and "Generate" not in p and "NestedLoop" not in p
        assert {r.node_id for r in hits.filter("query_id = 1 AND rank = 1").collect()} == {"1-1"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_index_tables_are_written_without_a_sort_by_folder(spark, scratch, monkeypatch):
    """The tables derived from the nodes are written unsorted, and the session's setting comes back."""
    from pyspark.sql import DataFrameWriter

    from quarry.config import RagConfig
    from quarry.sources import index_store as I

    name, seen, write = "spark.sql.maxConcurrentOutputFileWriters", {}, DataFrameWriter.parquet

    def parquet(self, path, *a, **k):
        seen[path.split("/")[-2]] = spark.conf.get(name)
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, f"alpha beta{i % 7}. gamma {i}! delta" if i % 5 else None) for i in range(60)], "doc_id long, text string")
    cfg = RagConfig().but(layout={"partitions": 4})
    I.upsert_index(spark, docs, f"{scratch}/index", cfg)
    assert {t: seen[t] != before for t in ("nodes", "forward", "vectors", "postings")} == \
        {"nodes": False, "forward": True, "vectors": True, "postings": True}
    assert spark.conf.get(name) == before
    idx = I.load_index(spark, f"{scratch}/index", cfg)
    ids = {r[0] for r in idx.nodes.select("node_id").collect()}
    assert len(ids) == 48 * 3
    for rows in (idx.vectors, idx.forward):  # each row stands in the folder of its document
        assert sorted(r[0] for r in rows.select("node_id").collect()) == sorted(ids)
    assert idx.forward.filter(I.part_of("doc_id", 4) != F.col("part")).count() == 0


def test_open_files_resets_after_an_error(spark):
    from quarry.session import open_files

    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    with pytest.raises(ValueError):
        with open_files(spark):
            assert spark.conf.get(name) != before
            raise ValueError
    assert spark.conf.get(name) == before


def test_postings_are_gathered_over_batches(monkeypatch):
    """A term of several batches goes to the shuffle in full rows, and comes back as it was."""
    import pyarrow as pa

    from quarry.operators import postings as P

    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("dl", pa.int32()), ("terms", pa.list_(pa.string())),
                        ("tfs", pa.list_(pa.int32()))])
    rows = [{"doc_id": (d << 40) - d, "pos": d % 3, "dl": 70_000 + d, "terms": ["a"] + [f"t{d % 11}"] * (d % 2), "tfs": [d + 1] + [3] * (d % 2)}
            for d in range(300)]
    batches = [pa.RecordBatch.from_pylist(rows[i:i + 50], schema) for i in range(0, 300, 50)]
    empty = pa.RecordBatch.from_pylist([{"doc_id": 1, "pos": 0, "dl": 0, "terms": [], "tfs": []}], schema)

    def postings(size):
        monkeypatch.setattr(P, "GATHERED", size)
        out = [b for b in P._gather([empty, *batches, empty])]
        got = []
        for b in out:
            for term, data in zip(b["term"].to_pylist(), b["data"].to_pylist()):
                n = len(data) // P.POSTING.itemsize
                raw = np.frombuffer(data, np.uint8)[P._turned(np.array([0]), n)]
                got += [(term, *map(int, x)) for x in raw.view(P.POSTING).ravel()]
        return sorted(got), sum(b["term"].to_pylist().count("a") for b in out)

    want = sorted((t, r["doc_id"], r["pos"], f, r["dl"]) for r in rows for t, f in zip(r["terms"], r["tfs"]))
    assert postings(1 << 20) == (want, 3)  # 300 postings of one term: 128, 128 and 44; one row a batch before
    assert postings(1) == (want, 6)
    assert [*P._gather([empty])] == []


def test_blocks_are_sorted_once(spark):
    from quarry.operators import postings as P

    forward = spark.createDataFrame([(1, 0, 2, ["a", "b"], [1, 1])], "doc_id long, pos int, dl int, terms array<string>, tfs array<int>")
    assert P.build_blocks(forward, 4)._jdf.queryExecution().optimizedPlan().toString().count("Sort [") == 1
