"""The findings of round 4: index build and keyword scan."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.config import RagConfig


def test_stems_of_distinct_tokens(spark):
    """The index stems the distinct tokens of a batch as ``stem`` does each token; equal stems are one term."""
    from quarry.functions.text import stemmed, stem
    from quarry.operators.embed import with_terms

    words = ["ties", "ies", "s", "as", "us", "bus", "glass", "dogs", "dog", "és", "ößs", "aies", "iess", "1s", "ss", "\U0001d41as", "word"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert stemmed(pa.array(words)).to_pylist() == [r[0] for r in df.select(stem("w")).collect()]
    docs = spark.createDataFrame([(1, "Dogs dog ties tie tys"), (2, None), (3, "")], "id int, text string").coalesce(1)
    plan = with_terms(docs, "text", True)
    assert "rlike" not in plan._jdf.queryExecution().executedPlan().toString().lower()
    got = {r.id: (list(r._ts.terms), list(r._ts.tfs)) for r in plan.collect()}
    assert got == {1: (["dog", "tie", "ty"], [2, 1, 2]), 2: ([], []), 3: ([], [])}


def test_document_frequencies_come_from_the_blocks(spark, scratch, monkeypatch):
    from quarry.sources import index_store as I

    def unused(*_):
        raise AssertionError("the terms of a whole layer are not counted again")

    docs = spark.createDataFrame([(i, f"alpha beta{i % 7}. gamma {i}! alpha alpha" if i % 5 else None) for i in range(400)], "doc_id long, text string")
    cfg = RagConfig().but(layout={"partitions": 2})
    monkeypatch.setattr(I, "doc_freq", unused)
    I.upsert_index(spark, docs, f"{scratch}/index", cfg)
    idx = I.load_index(spark, f"{scratch}/index", cfg)
    want = {r.term: r.n for r in idx.forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert {r.term: r.df for r in idx.df.collect()} == want and want["alpha"] == 640


@pytest.mark.parametrize("spread", [0, 3, 10 ** 9])
def test_scores_of_common_and_rare_terms(monkeypatch, spread):
    """Sums over the postings of each query's terms, whichever way a term is added up."""
    from quarry.operators import sparse

    monkeypatch.setattr(sparse, "SPREAD", spread)
    rng = np.random.default_rng(3)
    idf = {f"t{i}": 0.1 + i / 5 for i in range(30)}
    pairs = [(q, f"t{t}") for q in range(12) for t in rng.choice(30, size=6, replace=False)]
    asked = sparse.Asked([q for q, _ in pairs], [t for _, t in pairs], [idf[t] for _, t in pairs])
    place = {t: i for i, t in enumerate(asked.terms.to_pylist())}
    posts = [(n, t, 0.5 + n / 9) for n in range(40) for t in sorted(rng.choice(list(place), size=n % 5, replace=False))]
    got = asked.score(40, *(np.array(x) for x in ([p[0] for p in posts], [place[p[1]] for p in posts], [p[2] for p in posts])))
    want = np.zeros((40, 12))
    for n, t, w in posts:
        for q, of in enumerate(asked.keys):
            want[n, q] += w * idf[t] * ((of, t) in pairs)
    assert (np.isneginf(got) == (want == 0)).all() and np.allclose(np.where(want > 0, got, 0), want)


def test_embedding_does_not_count_terms_first(spark):
    """One Python step from the tokens to the vector, the one of the counted terms."""
    from quarry.operators.embed import Embedder, hashed_vector, with_terms

    df = spark.createDataFrame([(1, "Dogs dog ties a a a"), (2, None), (3, "..."), (4, "é É ties")], "id int, text string")
    for stemming in (False, True):
        got = Embedder(16, with_stemming=stemming).embed(df)
        assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        want = with_terms(df, "text", stemming).withColumn("v", hashed_vector(F.col("_ts"), 16))
        assert {r.id: r.vector for r in got.collect()} == {r.id: r.v for r in want.collect()}


def test_a_slice_of_the_ledger_reads_its_own_prompts(spark, scratch, monkeypatch):
    from quarry.operators import ledger as L

    read, complete = [], L.complete
    monkeypatch.setattr(L, "complete", lambda df, *a: read.append(df) or complete(df, *a))
    df = spark.createDataFrame([(i, f"prompt {i % 60}") for i in range(90)], "id long, prompt string")
    out = L.Ledger(f"{scratch}/ledger", slice=15).complete(df, context=None, query=None)
    assert out.count() == 90 and out.filter("response IS NULL OR error IS NOT NULL").count() == 0
    assert len(read) == 4 and sum(d.count() for d in read) == 60
    for d in read:
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(_slice" in plan


@pytest.mark.parametrize("k", [1, 7])
def test_close_scores_in_single_precision(spark, monkeypatch, k):
    """Neighbours that differ less than single precision can tell: the k best by the scores of double precision."""
    from quarry.operators import dense as D

    rng = np.random.default_rng(11)
    centre = rng.normal(size=(4, 8))
    v = centre[np.arange(900) % 4] + rng.normal(size=(900, 8)) * rng.choice([1e-7, 1e-4, 1e-3], size=(900, 1))
    monkeypatch.setattr(D, "FEW", 10)
    monkeypatch.setattr(D, "FIRST", 16)
    monkeypatch.setattr(D, "GROUP", 400)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, vector array<double>")
    rows = D.dense_top_k(df.filter("vec_id < 60").withColumnRenamed("vec_id", "query_id"), df, k, id_col="vec_id", exclude_self=True).collect()
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    score = np.round(unit[:60] @ unit.T, 6)
    want = {(q, i, n + 1) for q in range(60) for n, i in enumerate([i for i in np.lexsort((np.arange(900), -score[q])) if i != q][:k])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in rows} == want


def test_chunks_are_cut_before_they_become_rows(spark):
    """A chunk's row does not carry its whole document, and the index's nodes get no windows."""
    from quarry.operators import chunk as C

    docs = spark.createDataFrame([(1, "One two. Three four five! Six"), (2, ""), (3, None)], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (C.token_chunk_nodes(docs, 3, 1), C.sentence_pack_nodes(docs, 3, 1)):
        assert "posexplode(transform(" in plan(df)
    assert [(r.node_id, r.text) for r in C.token_chunk_nodes(docs, 3, 1).orderBy("pos").collect()] == \
        [("1-0", "One two. Three"), ("1-1", "Three four five!"), ("1-2", "five! Six")]
    bare = C.chunk(docs, RagConfig(), windows=False)
    assert "slice(" not in plan(bare) and "slice(" in plan(C.chunk(docs, RagConfig()))
    full = C.chunk(docs, RagConfig()).drop("window").collect()
    assert sorted(bare.drop("window").collect()) == sorted(full) and bare.columns == C.NODE_COLUMNS


def test_the_adapters_chunks_are_made_once(spark, monkeypatch):
    from quarry.plans import catalog_eval, catalog_more

    made, settled = [], []
    chunks, settle = catalog_eval._b3, catalog_more.settle
    monkeypatch.setattr(catalog_eval, "_b3", lambda *a: made.append(1) or chunks(*a))
    monkeypatch.setattr(catalog_more, "settle", lambda df, tag: settled.append(tag) or settle(df, tag))
    split, _, qv, nv = catalog_more._p6_parts(spark, "/root/testdata/sf0.001")
    assert made == [1] and settled == ["chunks", "split"]
    for df in (split, qv, nv):
        assert "documents.parquet" not in df._jdf.queryExecution().executedPlan().toString()


def test_signatures_meet_by_halves(spark):
    """A vector goes to two groups of a table, as it came; the pairs are those whose signatures differ in one bit at most."""
    from quarry.operators import approx

    rng = np.random.default_rng(2)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 5)).astype(np.float32))]
    rows += [(1000, [0.0] * 5), (1001, None), (1002, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>").repartition(3)
    signed = approx._signed(df, "vec_id", "vector", 11, 5)
    assert signed.schema["vec"].dataType.elementType.typeName() == "float"
    classes = approx._classes(signed).localCheckpoint()
    vecs = {bytes(r.cls): (np.array(r.vec, float), r.sigs) for r in classes.collect()}
    assert len(vecs) == 400
    unit = lambda v: v / np.sqrt((v * v).sum())
    want = {(a, b): round(float(unit(x) @ unit(y)), 6) for a, (x, s) in vecs.items() for b, (y, t) in vecs.items()
            if any((i ^ j).bit_count() <= 1 for i, j in zip(s, t))}
    found = approx.candidates(classes, classes, 11)
    got = {(bytes(r.q), bytes(r.c)): r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(want[p] - s) < 2e-6 for p, s in got.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array(struct(half") + plan.count("Generate explode(array(named_struct(half") == 2
